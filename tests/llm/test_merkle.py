"""The Merkle manifest against a tree built by its definition."""

import random
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def by_definition(nodes):
    """The root of a tree, and each leaf's runs: (its run, its place there) from the bottom up."""
    paths, level, at = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for path, a in zip(paths, at):
            path.append((runs[a // 16], a % 16))
        at, level = [a // 16 for a in at], [h(*r) for r in runs]
    return level[0], paths


def expected(rows, changed):
    """{row number: (leaf, subroot, root, proof, folded)} of rows (id, group, text)."""
    key = lambda r: (r[0] is not None, r[0] or 0, leaf(*r))
    groups = {}
    for n, r in enumerate(rows):
        groups.setdefault(r[1], []).append(n)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: by_definition([leaf(*rows[n]) for n in sorted(groups[g], key=lambda n: key(rows[n]))]) for g in names}
    root, above = by_definition([made[g][0] for g in names])
    out = {}
    for g, over in zip(names, above):
        for n, path in zip(sorted(groups[g], key=lambda n: key(rows[n])), made[g][1]):
            node, siblings = leaf(*changed(rows[n])), ""
            for run, at in path + over:
                siblings += "".join(run[:at] + run[at + 1 :])
                node = h(*run[:at], node, *run[at + 1 :])
            out[n] = leaf(*rows[n]), made[g][0], root, h(siblings), node
    return out


def got(frame, **how):
    out = merkle.prove_rows(frame, ["id", "group", "text"], id="id", group="group", **how)
    return sorted((r["id"] is not None, r["id"] or 0, r["group"] or "", r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in out.collect())


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [256, 1, 257], [4096], [4097, 4096, 300, 17, 1]])
def test_proofs_by_definition(spark, sizes):
    random.seed(sum(sizes))
    rows = [(i, f"g{n}", random.choice(["Text", "low", "ÉA", ""]) + str(i)) for n, size in enumerate(sizes) for i in random.sample(range(10**6), size)]
    change = lambda r: (r[0], r[1], r[2].replace("T", "t").replace("A", "a") if r[0] % 3 == 0 else r[2])
    want = expected(rows, change)
    frame = spark.createDataFrame(rows, "id long, group string, text string")
    made = got(frame, changed={"text": F.translate("text", "TA", "ta")}, where=F.col("id") % 3 == 0)
    assert made == sorted((True, r[0], r[1], *want[n], want[n][4] == want[n][2]) for n, r in enumerate(rows))
    assert len({w[2] for w in want.values()}) == 1


def test_many_groups_nulls_and_repeats(spark):
    rows = [(i, f"s{i}", "x") for i in range(4300)] + [(1, None, None), (None, None, "A"), (1, None, None), (2, "", ""), (2, "", "-"), (None, "é", "long " * 50_000), (7, "\U0001f600", "x"), (7, "￮", "x")]
    want = expected(rows, lambda r: r)
    frame = spark.createDataFrame(rows, "id long, group string, text string").withColumns({c: F.lit(0) for c in ("key", "digest", "other", "part", "index", "leaf")})
    assert got(frame) == sorted((r[0] is not None, r[0] or 0, r[1] or "", *want[n], True) for n, r in enumerate(rows))
    assert got(frame.limit(0)) == []


def test_ids_that_are_strings_or_clash(spark):
    frame = spark.createDataFrame([("b", "s", "t"), ("a", "s", "t")], "`a.b` string, part string, index string")
    out = merkle.prove_rows(frame, ["a.b", "part", "index"], id="a.b", group="part").collect()
    assert {r["a.b"] for r in out} == {"a", "b"} and all(r["verified"] and r["part"] == "s" for r in out)


@pytest.mark.parametrize("leaves", [1, 2, 15, 16, 17, 255, 256, 257, 1000, 4095, 4096, 4097, 65536])
def test_places_are_an_order_of_the_nodes(leaves):
    for levels in {merkle.levels_of(leaves), max(merkle.levels_of(leaves), 4)}:
        made = merkle.places(leaves, levels)
        assert [len(a) for a in made] == [-(-leaves // 16**k) for k in range(levels)]
        assert sorted(np.concatenate(made).tolist()) == list(range(merkle.nodes_of(leaves, levels)))
        for k, level in enumerate(made):
            for i in {0, len(level) - 1, len(level) // 3}:
                assert merkle.place(k, i, leaves, levels) == level[i]
    # The root comes first, then its children, and a lowest subtree's nodes stand together.
    made = merkle.places(4096, 4)
    assert made[3].tolist() == [0] and made[2].tolist() == list(range(1, 17)) and (np.ptp(made[0].reshape(-1, 16), axis=1) == 15).all() and (made[1] == made[0][::16] - 1).all()


def test_a_written_manifest_answers_for_single_rows(spark, tmp_path):
    frame = spark.range(5000).select(F.col("id"), F.lit("=g").alias("key"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), F.lit(None).cast("binary").alias("other"))
    made = merkle.manifest(frame)
    made.write(str(tmp_path))
    root = made.root().first()["root"].encode()
    for position in (0, 15, 4095, 4096, 4999):
        path = merkle.lookup(spark, str(tmp_path), "groups", "=g", position) + merkle.lookup(spark, str(tmp_path), "top", "", 0)
        assert merkle.fold(sha256(str(position).encode()).hexdigest().encode(), path) == root
        assert merkle.fold(b"0" * 64, path) != root
    with pytest.raises(KeyError):
        merkle.lookup(spark, str(tmp_path), "groups", "=g", 9000)
