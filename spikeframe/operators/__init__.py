from .network import CompiledNetwork, Network, compile_network
from .simulate import Simulator
from .tick import TickPolicy

__all__ = ["CompiledNetwork", "Network", "compile_network", "Simulator", "TickPolicy"]
