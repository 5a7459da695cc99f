from __future__ import annotations

from collections import defaultdict

from bitquarry.operators.motion import m3_merge


def merged(spatial, most, both):
    """The merge list of one block from all its spatial candidates (l0, l1), one after the other."""
    out = []
    for c in spatial:
        if len(out) < most and c not in out:
            out.append(c)
    n = len(out)
    for left in spatial[:n] if both else ():
        for right in spatial[1:n]:
            pair = left[0], right[1]
            if len(out) < most and None not in pair and pair not in out:
                out.append(pair)
    zero = 0
    while len(out) < most:
        at = f"{zero % max(most, 1)}:0:0"
        if (at, at if both else None) not in out:
            out.append((at, at if both else None))
        zero += 1
    return out


def test_merge_lists_take_candidates_of_any_number(spark, tmp_path):
    # six equal lines, then others: the list goes on with the seventh
    lines = [(o, k, 2 if k <= 6 else k, 2 if k <= 6 else 3 * k + o, "N" if k % 4 else "AR"[o % 2]) for o in range(1, 21) for k in range(1, 12)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spatial = defaultdict(list)
    for o, _, part, supp, flag in lines:
        spatial[o].append((f"{part % 2}:{part % 3}:0" if flag != "R" else None, f"{supp % 2}:{supp % 2}:1" if flag != "A" else None))
    want = {(o, rank, *c) for o, cs in spatial.items() for rank, c in enumerate(merged(cs, o % 5 + 1, o % 2 == 0))}
    assert {tuple(r) for r in m3_merge(spark, str(tmp_path)).select("id", "rank", "l0", "l1").collect()} == want
