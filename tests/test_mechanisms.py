"""Selection by rank, binary search, tiles, memory parts, keyed stream state, kept spans, drawn counts."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lingualoom.functions import protect as P
from lingualoom.functions.search import last_at_most
from lingualoom.operators import compare as cmp
from lingualoom.operators import inline as I
from lingualoom.operators import ranks, report, sheet, spread
from lingualoom.operators.memory import SCHEMA, Memory
from lingualoom.plans import recover
from lingualoom.streaming import jobs


@pytest.mark.parametrize("few", [1_000_000, 20])
def test_values_by_rank_are_exact(spark, few):
    rng = random.Random(2)
    rows = [(g, None if rng.random() < 0.05 else rng.choice([0.5, 0.25, rng.random()])) for g in "ab" for _ in range(900)] + [("c", 0.125), ("d", None)]
    table = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in ranks.at_ranks(table, ["g"], "v", report._middle, few).collect()}
    assert set(got) == {"a", "b", "c"}
    for g in got:
        values = sorted(v for h, v in rows if h == g and v is not None)
        assert got[g]["n"] == len(values)
        assert (got[g]["low"], got[g]["high"]) == (values[(len(values) - 1) // 2], values[len(values) // 2])
    alone = ranks.at_ranks(table, [], "v", report._listed, few).first()
    values = sorted(v for _, v in rows if v is not None)
    assert alone["low"] == values[int(len(values) * 0.95) - 1]
    assert ranks.at_ranks(table.limit(0), [], "v", report._middle).count() == 0


def test_binary_search(spark):
    cases = [([], 3), ([1], 0), ([1], 1), ([1, 4, 9], 8), ([1, 4, 9], 9), (list(range(0, 200, 2)), 77), ([2, 2, 2], 2)]
    table = spark.createDataFrame(cases, "a array<int>, x int").select("a", "x", last_at_most(F.col("a"), F.col("x"), 100).alias("at"))
    for a, x, at in table.collect():
        assert at == sum(v <= x for v in a) - 1


def test_tall_and_overlapping_ranges_over_many_tiles(spark):
    rng = random.Random(7)
    cells = [(s, rng.randrange(300), rng.randrange(20_000), k) for k, s in enumerate(["x", "y"] * 400)] + [("x", 5, 10, 1)] * 3
    merges = [("x", 9, 0, 0, 299, 19_999), ("x", 3, 60, 4000, 70, 9000), ("y", 1, 0, 100, 0, 19_000), ("x", 4, 64, 0, 64, 19_999)]
    merges += [("y", 10 + k, 3 * k, 50 * k, 3 * k + 4, 50 * k + 5000) for k in range(90)]
    got = sheet.merge_range_lookup(
        spark.createDataFrame(cells, "sheet string, col int, row int, n int"),
        spark.createDataFrame(merges, "sheet string, ord int, c1 int, r1 int, c2 int, r2 int"),
    ).collect()
    assert sorted((r["sheet"], r["col"], r["row"], r["n"]) for r in got) == sorted(cells)
    for r in got:
        hits = [m for m in merges if m[0] == r["sheet"] and m[2] <= r["col"] <= m[4] and m[3] <= r["row"] <= m[5]]
        want = min(hits, key=lambda m: m[1])[2:] if hits else (r["col"], r["row"], r["col"], r["row"])
        assert (r["c1"], r["r1"], r["c2"], r["r2"]) == tuple(want) and r["merged"] == bool(hits)


def test_lookup_reads_the_parts_of_its_own_keys(spark, tmp_path):
    memory = Memory(spark, str(tmp_path / "memory"))
    keys = [f"{i * 2654435761 % 2**32:08x}" for i in range(600)]
    rows = lambda part: spark.createDataFrame([(k, "t" + k, "en", "o" + k) for k in part], SCHEMA)
    assert memory.rows().count() == 0 and memory.near(rows(keys[:3])).count() == 0
    memory.add(rows(keys[:300]), 0)
    few = rows(keys[:4])
    first = memory.near(few, 1)
    files = len(first.inputFiles())
    assert {r["unit_key"] for r in first.collect()} >= set(keys[:4]) and files <= 4
    memory.add(rows(keys[300:]), 1)
    # The memory has twice the rows; a lookup before the second batch reads what it read before, and after it two files a part.
    assert memory.near(few, 1).count() == first.count()
    assert len(memory.near(few, 2).inputFiles()) <= 2 * files
    memory.add(rows(keys[300:]), 1)
    assert memory.rows().count() == 600
    memory.compact(2)
    assert memory.rows().count() == 600 and len(memory.near(few).inputFiles()) <= 4
    memory.add(rows(["ffffffff"]), 2)
    memory.compact(3)
    assert memory.rows().count() == 601 and memory.rows(3).count() == 601


def test_outcomes_equal_a_pass_in_order(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rng = random.Random(9)
    rows = [(n, f"u{rng.randrange(6)}", rng.choice("abc"), start + timedelta(days=n)) for n in range(120)]
    late = {n for n, *_ in rows if n % 10 == 3}
    batches = [[r for r in rows if r[0] < 60 and r[0] not in late], [r for r in rows if r[0] >= 60 and r[0] not in late], [r for r in rows if r[0] in late]]
    schema = "n long, who string, what string, at timestamp"
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = jobs.document_stream(spark, str(tmp_path / "in/*"), spark.createDataFrame([], schema).schema, per_batch=1)
    horizon = timedelta(days=30)
    query = jobs.submission_outcomes(stream, ["who"], "what", ["at", "n"], "at", horizon, str(tmp_path / "out"))
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p.numInputRows]) == 3
    got = {r["n"]: r["outcome"] for r in spark.read.parquet(str(tmp_path / "out/outcomes")).collect()}
    known, want = {}, {}
    for batch in batches:
        for n, who, what, at in batch:
            if who not in known or at - known[who][1] > horizon:
                known[who] = (what, at)
                want[n] = "accepted"
            else:
                want[n] = "repeat" if what == known[who][0] else "conflict"
    assert got == want and {got[n] for n in late} >= {"repeat", "conflict"}


def test_identities_are_settled_in_one_pass_and_missing_values_are_told_apart(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(n, None if n % 4 == 0 else f"u{n % 400}", None if n % 3 == 0 else "a", start + timedelta(days=n // 400)) for n in range(2000)]
    batch = spark.createDataFrame(rows, "n long, who string, what string, at timestamp")
    state = spark.createDataFrame([("u1", "b", int(start.timestamp()) * 1_000_000)], "who string, _content string, _at long")
    told = jobs.settle(batch, state, ["who"], "what", ["at", "n"], "at", timedelta(days=30))
    assert "MapInPandas" in told._jdf.queryExecution().executedPlan().toString()
    known, want = {"u1": "b"}, {}
    for n, who, what, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        want[n] = "accepted" if who not in known else "repeat" if known[who] == what else "conflict"
        known.setdefault(who, what)
    assert {r["n"]: r["outcome"] for r in told.collect()} == want


NODE = "doc_id int, seg_no int, pos int, kind string, text string, style int, key int"


def test_addresses_and_terms_in_a_bold_run_never_reach_the_engine(spark):
    rows = [(0, 0, 0, "text", "看 ", 0, None), (0, 0, 1, "text", "https://a.example/x, Blue Moon和船.", 1, None), (0, 1, 0, "text", "https://b.example", 1, None)]
    paragraphs = I.paragraphs(spark.createDataFrame(rows, NODE)).withColumn("lang", F.lit("zh"))
    seen = []

    def translate(texts):
        seen.extend(r["text"] for r in texts.collect())
        return texts.withColumn("output", F.translate("text", "看和船", "LAB"))

    segments, out = recover.translate_formatted(paragraphs, translate, "en", ["Blue Moon"], "lang")
    told = {r["seg_no"]: (r["method"], r["error_code"]) for r in segments.collect()}
    assert told == {0: ("direct", None), 1: ("unchanged", None)}
    assert not any("example" in t or "Moon" in t for t in seen)
    shown = {r["seg_no"]: [(n["kind"], n["text"], n["style"]) for n in r["nodes"]] for r in out.collect()}
    assert ("keep", "https://a.example/x", 1) in shown[0] and ("keep", "Blue Moon", 1) in shown[0]
    assert "".join(t for _, t, _ in shown[0]) == "L https://a.example/x, Blue MoonAB."
    assert shown[1] == [("keep", "https://b.example", 1)]


def test_paragraphs_stay_rows_before_the_distinct_inputs(spark):
    paragraphs = I.paragraphs(spark.createDataFrame([(0, 0, 0, "text", "a", 0, None)], NODE))
    staged = spark.createDataFrame(paragraphs.collect(), paragraphs.schema)
    encoded = I.encode_tags(I.normalize_nodes(I.keep_spans(staged)))
    plan = encoded._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_drawn_counts_follow_the_poisson_distribution(spark):
    counts = cmp.draws([str(i) for i in range(300)], 1000, 0)
    assert counts.shape == (300, 1000) and abs(counts.mean() - 1) < 0.01 and abs(counts.var() - 1) < 0.02
    assert (cmp.draws(["7"], 1000, 0)[0] == counts[7]).all() and (cmp.draws(["7"], 1000, 1)[0] != counts[7]).any()
    rng = np.random.default_rng(3)
    delta = rng.normal(0.3, 1.0, 300)
    rows = spark.createDataFrame([("d", i, 0.0, float(x)) for i, x in enumerate(delta)] + [("one", 0, 0.0, 0.5)], "direction string, id int, a double, b double")
    means = cmp.bootstrap_means(rows).toPandas()
    own = means[means.direction == "d"]["mean"]
    assert len(own) == 1000 and own.mean() == pytest.approx(delta.mean(), abs=0.02) and own.std() == pytest.approx(delta.std() / 300**0.5, rel=0.1)
    assert set(means[means.direction == "one"]["mean"]) == {0.5}


def test_many_terms_and_patterns_from_left_to_right(spark):
    """The automaton against one alternation over everything."""
    rng = random.Random(11)
    terms = ["ab", "abc", "ab c", "b", "c d e", "a.example/x", "q.", "https://a.example/x b", "".join(rng.choice("xyz") for _ in range(5))]
    pieces = [*terms, "https://a.example/x,", "mail@b.example.", "<g1>", "/usr/lib/x", " ", "d", "é", "."]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 12))) for _ in range(600)]
    import re

    import regex

    ours = lambda p: re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", p)
    ordered = sorted(terms, key=lambda t: (-len(t), t))
    pattern = regex.compile("|".join([
        f"(?:{ours(P.TAG_LIKE)})", *[regex.escape(t) for t in ordered if " " in t], f"(?:{ours(P.SPANS)})", *[regex.escape(t) for t in ordered if " " not in t],
    ]))
    some = P.Terms(terms)
    want = []
    for text in texts:
        spans = []
        for m in pattern.finditer(text):
            kept = m[0] if m[0] in terms else regex.sub(P._TAIL, "", m[0])
            spans.append((m.start(), m.start() + len(kept)))
        assert some.find(text) == spans, text
        want.append(spans)
    table = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: [tuple(x) for x in r["s"]] for r in table.select("i", some.spans("t").alias("s")).collect()}
    assert [got[i] for i in range(len(texts))] == want
    patterns_only = {r["i"]: [tuple(x) for x in r["s"]] for r in table.select("i", P.plain_spans(F.col("t")).alias("s")).collect()}
    alone = P.Terms([chr(0x10FFFF)])
    assert all(patterns_only[i] == alone.find(t) for i, t in enumerate(texts))


def test_time_does_not_grow_with_the_number_of_terms():
    import time

    text = " ".join(f"word{k}" for k in range(20_000))
    times = []
    for n in (10, 10_000):
        some = P.Terms([f"term number {k}" for k in range(n)])
        some.find("warm")
        start = time.perf_counter()
        some.find(text)
        times.append(time.perf_counter() - start)
    assert times[1] < 5 * times[0] + 0.1


@pytest.mark.parametrize("how", ["left", "left_semi", "left_anti", "inner"])
def test_dealt_join_equals_a_plain_join(spark, how):
    rows = [(i, "hot" if i % 2 == 0 else f"k{i % 50}") for i in range(2000)] + [(5000, None)]
    many = spark.createDataFrame(rows, "i int, key string")
    few = spark.createDataFrame([("hot", 1), ("k3", 2), ("k5", 3), ("other", 4)], "key string, v int")
    staged, hot = spread.staged_with_hot(many, ["key"], "many", share=100)
    assert [r["_salts"] for r in hot.collect()] == [10]
    got = spread.dealt_join(staged, hot, few, ["key"], how, ["i"])
    want = many.join(few, "key", how)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("many-") <= 1


def test_a_shared_string_of_many_tables_travels_once(spark, monkeypatch):
    """Also if keys repeat, texts are missing or frequent, or lists; what is shuffled doesn't grow with the number of tables."""
    cells = [(d, i, p, f"c{p}") for d in range(5) for i in range(40) for p in range(i % 3 + 1)] + [(None, 1, 0, "n"), (1, None, 0, "m")]
    cells = spark.createDataFrame(cells, "doc_id long, idx long, pos long, location string")
    shared = [(d, i, None if i == 7 else "same" if i % 2 else f"text {i}") for d in range(4) for i in range(30)] + [(1, 3, "twice")]
    shared = spark.createDataFrame(shared, "doc_id long, idx long, text string")
    used = cells.groupBy("doc_id", "idx").count()
    want = sorted(map(repr, used.join(shared, ["doc_id", "idx"], "left").collect()))
    for share in (100_000, 3):
        assert sorted(map(repr, spread.once_join(used, shared, ["doc_id", "idx"], "text", share).collect())) == want
    lists = shared.withColumn("text", F.when(F.col("text").isNotNull(), F.array(F.struct("text"))))
    shown = sheet.sheet_string_fanout(cells, lists).collect()
    plain = sheet.sheet_string_fanout(cells, shared).collect()
    key = lambda r: (str(r["doc_id"]), str(r["idx"]), str(r["text"] and (r["text"] if isinstance(r["text"], str) else r["text"][0][0])), r["cells"], r["location"], r["error_code"])
    assert sorted(map(key, shown)) == sorted(map(key, plain)) and len(plain) == 203
    assert {r["error_code"] for r in plain if r["text"] is None} == {"invalid_document"}
    monkeypatch.setattr(spread, "HOT_KEYS", 1)
    assert sorted(map(repr, spread.once_join(used, shared, ["doc_id", "idx"], "text", 3).collect())) == want
    # Before the payloads meet their keys, each is one row.
    plan = sheet.sheet_string_fanout(cells, shared)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [_bits0" in plan
