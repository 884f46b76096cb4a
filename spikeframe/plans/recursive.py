"""Oracle text: the tick as one recursive DuckDB query over CTEs
``neurons``, ``rules`` and ``synapses``."""


def simulation_sql(ctes, ticks, final, scope="", reopen=False, inhibit_now=False,
                   inhibit_later=True, train=False):
    """``final`` selects from st(k, [scope,] nid, spikes, timer, is_open, pending);
    with ``train`` a CTE train(k, nid, spikes) joins tick k."""
    pre = f"{scope}, " if scope else ""
    same = f" AND r.{scope} = a.{scope}" if scope else ""
    edge = f" AND y.{scope} = b.{scope}" if scope else ""
    into = f" AND i.{scope} = b.{scope}" if scope else ""
    bpre = f"b.{scope}, " if scope else ""
    apre = f"a.{scope}, " if scope else ""
    now = "b.imm * y.weight" if inhibit_now else "greatest(b.imm * y.weight, 0)"
    later = "b.late * y.weight" if inhibit_later else "greatest(b.late * y.weight, 0)"
    outside = "+ coalesce(x.spikes, 0)" if train else ""
    joined = "LEFT JOIN train x ON x.k = b.k + 1 AND x.nid = b.nid" if train else ""
    if reopen:
        late = "CASE WHEN reopened THEN p0 ELSE 0 END"
        p2 = "CASE WHEN d > 0 THEN produced WHEN reopened THEN 0 ELSE p0 END"
        p3 = "b.p2"
    else:
        late = "CASE WHEN o1 AND d = 0 THEN p0 ELSE 0 END"
        p2 = "CASE WHEN d > 0 THEN produced ELSE p0 END"
        p3 = "CASE WHEN b.o2 THEN 0 ELSE b.p2 END"
    return f"""
WITH RECURSIVE {ctes},
st(k, {pre}nid, spikes, timer, is_open, pending) AS (
  SELECT 0, {pre}nid, CAST(initial_spikes AS BIGINT), 0, true, CAST(0 AS BIGINT) FROM neurons
  UNION ALL
  (WITH a AS (
     SELECT k, {pre}nid, spikes, greatest(timer - 1, 0) AS t1, timer = 1 AS reopened,
            is_open OR timer = 1 AS o1, pending AS p0
     FROM st WHERE k < {ticks}),
   f AS (
     SELECT {apre}a.nid, min(r.rule_idx) AS rule_idx
     FROM a JOIN rules r ON r.nid = a.nid{same} AND a.o1 AND a.spikes >= r.threshold
     GROUP BY ALL),
   g AS (
     SELECT a.*, coalesce(r.consumed, 0) AS consumed, coalesce(r.produced, 0) AS produced,
            coalesce(r.delay, 0) AS d
     FROM a LEFT JOIN f ON f.nid = a.nid{same.replace("r.", "f.", 1)}
            LEFT JOIN rules r ON r.nid = f.nid AND r.rule_idx = f.rule_idx{same.replace("a.", "f.")}),
   b AS (
     SELECT k, {pre}nid, spikes - consumed AS s2, CASE WHEN d > 0 THEN d ELSE t1 END AS t2,
            o1 AND d = 0 AS o2, {p2} AS p2,
            CASE WHEN d > 0 THEN 0 ELSE produced END AS imm, {late} AS late
     FROM g),
   i AS (
     SELECT {bpre}y.dest_id AS nid, sum({now} + {later}) AS inc
     FROM b JOIN synapses y ON y.source_id = b.nid{edge} WHERE b.imm > 0 OR b.late > 0
     GROUP BY ALL)
   SELECT b.k + 1, {bpre}b.nid,
          CAST(b.s2 + CASE WHEN b.o2 THEN coalesce(i.inc, 0) {outside} ELSE 0 END AS BIGINT),
          CAST(b.t2 AS INTEGER), b.o2, CAST({p3} AS BIGINT)
   FROM b LEFT JOIN i ON i.nid = b.nid{into} {joined})
)
{final}"""
