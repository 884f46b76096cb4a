"""Spiking-network analytics on Spark DataFrames."""

from .operators import CompiledNetwork, Network, Simulator, TickPolicy, compile_network
from .session import build_session

__all__ = ["CompiledNetwork", "Network", "Simulator", "TickPolicy", "build_session",
           "compile_network"]
