"""The corpus operators against brute force, and on nulls, empty texts and tables, repeated rows and extra columns."""

import re
import tracemalloc
import zipfile
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lingualoom.llm import (
    decontaminate, fingerprints, graph, licenses, mixing, pii, quality, simhash, substrings, toxicity, warc,
)
from lingualoom.session import fresh_path

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp string, label int"


def table(spark, rows):
    """Documents with columns of clashing names."""
    full = [(i, t, "en", s, len(t or ""), 7, "x", 3) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    return [f"w{k}" for k in rng.integers(0, vocabulary, n)]


ODD = [(None, "no id", None), (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (4, "one", "b"), (5, "ab " * 30_000, "b"), (6, "Ünï \U0001F600 wörd", "")]


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# Components


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (300, 301), (301, 300), (None, 5)]
    found = graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    groups = {}
    for node, label in found:
        groups.setdefault(label, set()).add(node)
    assert sorted(map(sorted, groups.values())) == [list(range(41)), list(range(100, 160)), [200], [300, 301]]
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# 1


def shingles(text):
    w = tokens(text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_fingerprints_estimate_likeness_and_edit_as_told(spark):
    rows = [(10 * k, " ".join(prose(k % 7, 50 + 20 * k)), "s") for k in range(30)]
    got = {r["id"]: r for r in fingerprints.edited_pairs(table(spark, rows)).withColumn(
        "near", fingerprints.likeness(F.col("own"), F.col("edited_print"))).collect()}
    order = sorted(rows, reverse=True)
    for at, (i, text, _) in enumerate(order):
        after = order[(at + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i]["edited"] == edited and got[i]["n_chars"] == len(text)
        a, b = shingles(text), shingles(edited)
        assert abs(got[i]["near"] - len(a & b) / len(a | b)) < 0.2


def test_fingerprints_of_odd_rows(spark):
    got = fingerprints.edited_pairs(table(spark, ODD)).collect()
    assert len(got) == len(ODD)
    empty = {tuple(r["own"]) for r in got if r["id"] in (1, 2)}
    assert len(empty) == 1 and all(len(r["own"]) == 128 for r in got)
    assert len({tuple(r["own"]) for r in got if r["id"] == 4}) == 1
    assert fingerprints.edited_pairs(table(spark, [])).count() == 0
    alone = fingerprints.edited_pairs(table(spark, [(7, "abcd", "s")])).first()
    assert alone["edited"] == "abab"


def test_next_row_across_stretches(spark):
    ids = [1, 2, 5000, 5001, 9_000_000, -3]
    rows = table(spark, [(i, str(i), "s") for i in ids]).select("doc_id", "text")
    got = {r["doc_id"]: r["next"]["text"] for r in fingerprints.with_next(rows, "doc_id", ["text"]).collect()}
    down = sorted(ids, reverse=True)
    assert got == {i: str(down[(k + 1) % len(down)]) for k, i in enumerate(down)}


# 2


def test_warc_round_trip(spark):
    pages = [(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, None, None), (4, "u\r\nX: y", ""), (5, "v", "é" * 100_000), (None, "w", "<p>x</p>"), (None, "w", "only")]
    rows = spark.createDataFrame([(*p, 1, "z") for p in pages], "page_id long, url string, html string, payload int, digest string")
    got = warc.round_trip(rows, payloads=True).collect()
    assert all(r["error"] is None for r in got) and len(got) == len(pages)
    found = {(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got}
    assert found == {(1, 8, "response", None), (2, 8, "revisit", 1), (3, 0, "response", None), (4, 0, "revisit", 3), (5, 200_000, "response", None), (None, 8, "revisit", 1), (None, 4, "response", None)}
    assert next(r for r in got if r["page_id"] == 5)["payload"].decode() == "é" * 100_000
    assert next(r for r in got if r["page_id"] == 1)["payload_digest"] == warc.base32_sha1(b"<p>x</p>")
    assert warc.round_trip(rows.limit(0)).count() == 0
    small = warc.round_trip(rows, least_bytes=5).filter("record_type = 'revisit'").collect()
    assert {r["page_id"] for r in small} == {2, None}


def test_zip64_directory_and_damaged_archives(spark, tmp_path):
    import io
    import struct

    rows = spark.createDataFrame([(i, "u", f"<p>{i}</p>") for i in range(50)], "page_id long, url string, html string")
    manifest = warc.write_archives(warc.assign_roles(rows), fresh_path(spark, "warc"), archive_bytes=2000)
    paths = [r["path"] for r in manifest.collect()]
    assert len(paths) > 3
    whole = open(paths[0].removeprefix("file:"), "rb").read()
    with zipfile.ZipFile(io.BytesIO(whole)) as other:
        assert set(other.namelist()) == {warc.DATA, warc.INDEX} and other.testzip() is None
    # The same directory told by ZIP64 records: sizes and places are all ones in the short form.
    end = whole.rindex(warc.END)
    length, start = struct.unpack_from("<II", whole, end + 12)
    wide = warc.END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 2, 2, length, start)
    locator = warc.LOCATOR64 + struct.pack("<IQI", 0, end, 1)
    short = warc.END + struct.pack("<HHHHIIH", 0, 0, warc.ALL16, warc.ALL16, warc.ALL32, warc.ALL32, 0)
    files = {"wide": whole[:end] + wide + locator + short, "cut": whole[: end - 30], "none": b"", "bent": whole.replace(b"\x1f\x8b", b"\x00\x00", 1)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    read = lambda name: warc.read_archives(spark.createDataFrame([(str(tmp_path / name),)], "path string")).collect()
    plain = warc.read_archives(spark.createDataFrame([(paths[0],)], "path string")).collect()
    assert sorted(r["page_id"] for r in read("wide")) == sorted(r["page_id"] for r in plain)
    assert [r["error"] for r in read("cut")] == ["no_directory"] and [r["error"] for r in read("none")] == ["no_directory"]
    assert sum(r["error"] is not None for r in read("bent")) == 1
    assert [r["error"] for r in read("missing")] == ["FileNotFoundError"]


# 3


def test_licenses_found_and_clean_text_left_alone(spark):
    clean = [(100 + k, " ".join(prose(k, 60)) + "\n" + " ".join(prose(k + 50, 30)), "s") for k in range(40)]
    marked = [(k, f"{' '.join(prose(k, 40))}\n{text}\n{' '.join(prose(k, 20))}", "s") for k, (_, text) in enumerate(licenses.TEMPLATES)]
    got = {r["doc_id"]: [x["family"] for x in r["licenses"]] for r in licenses.scan(table(spark, clean + marked)).collect()}
    assert all(got[i] == [] for i, _, _ in clean)
    right = sum(got[k] == [family] for k, (family, _) in enumerate(licenses.TEMPLATES))
    assert right >= 0.95 * len(licenses.TEMPLATES)
    odd = licenses.scan(table(spark, ODD)).collect()
    assert len(odd) == len(ODD) and all(r["licenses"] == [] for r in odd)
    assert licenses.scan(table(spark, [])).count() == 0


# 4


def test_licenses_in_wrapped_and_long_paragraphs(spark):
    clean = [(100 + k, " ".join(prose(k, 60)) + "\n\n" + " ".join(prose(k + 50, 30)), "s") for k in range(40)]
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met"
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation"
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    long = [f"{' '.join(prose(k, 300))} {mit} {' '.join(prose(k + 9, 300))}" for k in range(5)]
    rows = [(1, bsd, "s"), (2, gpl, "s"), (3, f"{bsd}\r\n \r\n{gpl}", "s"), *[(10 + k, t, "s") for k, t in enumerate(long)]]
    got = {r["doc_id"]: (r["n_paragraphs"], [x["family"] for x in r["licenses"]]) for r in licenses.scan(table(spark, clean + rows)).collect()}
    assert got[1] == (1, ["bsd"]) and got[2] == (1, ["gpl"]) and got[3] == (2, ["bsd", "gpl"])
    assert all(got[10 + k] == (1, ["mit"]) for k in range(5))
    assert all(got[i] == (2, []) for i, _, _ in clean)


def test_quality_separates_and_shrinks(spark):
    good = [(k, " ".join(prose(k, 80)).capitalize() + ".", "a" if k % 3 else None) for k in range(60)]
    bad = [(100 + k, " ".join(w + "%%%" for w in prose(k, 80)), "b") for k in range(20)]
    docs = table(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i, _, _ in good[::2] + bad[::2]], "doc_id long, quality int, toxic int")
    got = {r["row"]["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert {i for i, r in got.items() if r["rejected"]} == {i for i, _, _ in bad}
    assert got[100]["site_rate"] > got[1]["site_rate"]
    assert quality.keep_good(docs, labels).columns == docs.columns
    odd = quality.classify(table(spark, ODD), labels.limit(0)).collect()
    assert len(odd) == len(ODD) and not any(r["rejected"] for r in odd)
    assert quality.classify(table(spark, []), labels).count() == 0


# 5


def plain_simhash(text):
    w = tokens(lower(text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def connected(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(ids, 2):
        if linked(a, b):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(spark, monkeypatch):
    # Short texts of few words give many fingerprints close to each other.
    rows = [(k, " ".join(prose(k, 1 + k % 9, 3)), "s") for k in range(250)] + [(900, None, "s"), (901, "  ", "s")]
    want = {i: plain_simhash(t) for i, t, _ in rows}
    groups = connected(list(want), lambda a, b: (want[a] ^ want[b]).bit_count() <= 2)
    for most in (2048, 4):  # whole buckets, then buckets cut into pairs of parts
        monkeypatch.setattr(simhash, "GROUP", most)
        got = simhash.near_duplicates(table(spark, rows)).collect()
        assert {r["id"]: r["fp"] & (2**64 - 1) for r in got} == want
        assert {r["id"]: r["component_id"] for r in got} == groups
    odd = simhash.near_duplicates(table(spark, ODD)).collect()
    assert len(odd) == len(ODD)
    assert {r["component_id"] for r in odd if r["id"] in (1, 2, 3)} == {1}
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_tiles_find_every_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = base[rng.integers(0, 40, 900)] ^ (np.uint64(1) << rng.integers(0, 63, 900).astype(np.uint64))
    fps = np.unique(np.r_[base, near])
    want = connected(range(len(fps)), lambda a, b: (int(fps[a]) ^ int(fps[b])).bit_count() <= 2)
    got = connected(range(len(fps)), lambda a, b, edges=set(map(frozenset, simhash.forest(fps[:, None], 2))): frozenset((a, b)) in edges)
    assert got == want


def test_near_duplicate_stage_keeps_the_first_of_each_group(spark, monkeypatch):
    rows = []
    for k in range(12):
        base = prose(k, 120, 10_000)
        for j in range(8):
            copy = list(base)
            for at in np.random.default_rng(100 * k + j).integers(0, 120, j):
                copy[at] = f"new{j}"
            rows.append((100 * k + j, " ".join(copy), "s"))
    rows += [(5000, None, "s"), (5001, "", "s"), (5002, "", "s"), (None, "x", "s")]
    sets = {i: frozenset(simhash.shingle_set(t, 5).tolist()) for i, t, _ in rows if i is not None}
    groups = connected(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    for most in (1 << 19, 300):
        monkeypatch.setattr(simhash, "SETS", most)
        docs = table(spark, rows)
        kept = simhash.keep_first(docs)
        assert kept.columns == docs.columns
        assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == sorted({*groups.values(), -1})
    twice = simhash.keep_first(table(spark, [(1, "b", "s"), (1, "b", "s"), (2, "c", "s")]))
    assert sorted(r["doc_id"] for r in twice.collect()) == [1, 2]


def test_near_duplicate_stage_misses_no_short_pair(spark):
    words = [prose(k, 8, 10**9) for k in range(300)]
    rows = [(2 * k, " ".join(w), "s") for k, w in enumerate(words)] + [(2 * k + 1, " ".join([*w, "more"]), "s") for k, w in enumerate(words)]
    assert sorted(r["doc_id"] for r in simhash.keep_first(table(spark, rows)).collect()) == [2 * k for k in range(300)]


def test_lists_of_short_sets_are_bounded(spark, monkeypatch):
    base, most, tiled = prose(5, 20, 10**9), [], simhash.tiled

    def seen(*args):
        lists = tiled(*args)
        most.append(lists.agg(F.max(F.size("both"))).first()[0])
        return lists

    monkeypatch.setattr(simhash, "GROUP", 64)
    monkeypatch.setattr(simhash, "tiled", seen)
    docs = table(spark, [(k, " ".join([*base, f"end{k}"]), "s") for k in range(600)])
    assert [r["doc_id"] for r in simhash.keep_first(docs).collect()] == [0]
    # Two parts, which a hash fills unevenly.
    assert most[-1] <= 4 * 64


def test_comparison_of_many_sets_in_little_memory():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, (150, 16), dtype=np.uint64)
    sets = [np.unique(np.r_[base[k % 150], rng.integers(0, 2**63, k // 150 % 6, dtype=np.uint64)]) for k in range(3000)]
    tracemalloc.start()
    found = simhash.alike(sets, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # One matrix, and 64 MB for the shingles that are counted at once.
    assert peak < 4 * 3000**2 + 120e6
    assert len(found) > 1000
    some = sets[::5]
    plain = [frozenset(s.tolist()) for s in some]
    want = connected(range(600), lambda a, b: len(plain[a] & plain[b]) >= 0.8 * len(plain[a] | plain[b]))
    assert want == connected(range(600), lambda a, b, edges=set(map(frozenset, simhash.alike(some, 0.8))): frozenset((a, b)) in edges)


# 6


def test_mix_reaches_targets_and_repeats_itself(spark):
    rows = [(k, " ".join(prose(k, 20)), ["a", "b", None, "\U0001F600"][k % 4 if k % 10 else 0]) for k in range(2000)]
    docs = table(spark, rows)
    got = mixing.mix_counts(docs)
    by = {(r["source_size"], r["target"]): r["taken"] for r in got.groupBy("source_size", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()}
    assert abs(sum(t for _, t in by) - 2000 * 20) < 1e-3
    assert all(t <= 3 * s + 1e-6 and abs(taken - t) < 0.1 * t for (s, t), taken in by.items())
    again = mixing.mix_counts(docs.repartition(7))
    assert sorted(map(tuple, again.select("doc_id", "copies").collect())) == sorted(map(tuple, got.select("doc_id", "copies").collect()))
    emitted = mixing.mix(docs)
    assert emitted.columns == docs.columns and emitted.count() == got.agg(F.sum("copies")).first()[0]
    odd = mixing.mix_counts(table(spark, ODD))
    assert odd.count() == len(ODD) and odd.filter("copies > 3").count() == 0
    assert mixing.mix_counts(table(spark, [])).count() == 0


def test_targets_share_the_excess_again(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got[None] == 0 and got["a"] == 30 and got["b"] == 300 and abs(sum(got.values()) - 1110) < 1e-6


# 7


def plain_contamination(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    w, hit, found = split(text), set(), set()
    for item_id, item in items:
        v = split(item)
        size = min(10, len(v))
        windows = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else set()
        for i in range(len(w) - size + 1 if v else 0):
            if tuple(w[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(item_id)
    return len(hit), sorted(map(str, found))


def test_contamination_against_brute_force(spark):
    items = [(k, " ".join(prose(k, n, 6)), 1) for k, n in enumerate([25, 12, 10, 9, 6, 3, 1, 40])] + [(50, None, 1), (51, "...", 1), (52, "word " * 30, 1), (53, "É Ü ß x y z a b c d e f", 1)]
    rows = [(k, ", ".join(prose(100 + k, 60, 6)).upper(), "s") for k in range(30)]
    rows += [(40, "xx " + items[0][1] + " yy " + items[7][1], "s"), (41, "word-" * 200, "s"), (42, "É Ü ß X y z a b c d", "s"), (43, "é ü ß X y z a b c d", "s")] + ODD
    bench = spark.createDataFrame(items, "item_id long, text string, h int")
    docs = table(spark, rows)
    found = decontaminate.contamination(docs, bench)
    k1, k2 = decontaminate.text_key(F.col("text"))
    got = docs.select("text", k1, k2).join(found, ["k1", "k2"], "left").select("text", "n_hit", "items").collect()
    assert len(got) == len(rows)
    for text, n_hit, ids in got:
        assert (n_hit or 0, ids or []) == plain_contamination(text, [(i, t) for i, t, _ in items])
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == sum(plain_contamination(t, [(i, t2) for i, t2, _ in items])[0] == 0 for _, t, _ in rows)
    assert decontaminate.contamination(docs, bench.limit(0)).count() == 0
    assert decontaminate.contamination(table(spark, []), bench).count() == 0


# 8

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        doubled = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and doubled % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


TRICKY = [
    "a@b.com.x@y.z a@b.c_d@e.f x", " 1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.0255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111",
    "5 4111111111111111 7-4111111111111111", "+1 (132) 555-1352 ++1 2 3 4 5 6 7 8 +1-", "9" * 5000 + " x@" + "a." * 500, "é@é.com \U0001F600a.b@c.de\U0001F600 1.1.1.1",
    "@." * 300 + "a@b.c" * 50, "1 2 3 4 5 6 7 8 9 0 " * 3000, "a" * 20000 + "@b.c", "4000000000000002 40000000000000020", "123456789012345 6", "12 4000000000000002-", "x1.2.3.4y",
]


def test_personal_data_against_brute_force(spark):
    rng = np.random.default_rng(3)
    noise = ["".join(rng.choice(list("12345 .-+@a()0"), 200)) for _ in range(300)]
    texts = TRICKY + noise + [t for _, t, _ in ODD]
    docs = table(spark, [(k, t, "s") for k, t in enumerate(texts)])
    base = F.concat(*[pii.listed(F.col(f"_{k}"), k) for k in pii.KINDS])
    got = {r["i"]: r["s"] for r in pii.with_spans(docs).select(F.col("row.doc_id").alias("i"), base.alias("s")).collect()}
    assert got == {k: plain_spans(t) for k, t in enumerate(texts)}
    assert pii.with_spans(table(spark, [])).count() == 0


def test_terms_that_disclose_are_found_and_masked(spark):
    rows = [(k, f"{' '.join(prose(k, 30))} ask Zorblatt at zorb@corp.com today {' '.join(prose(k + 99, 30))}", "s") for k in range(4)]
    rows += [(100 + k, " ".join(prose(k, 50)) + " ask at today", "s") for k in range(80)] + [(200, None, "s")]
    docs = table(spark, rows)
    found = pii.with_spans(docs).collect()
    terms = {r["row"]["doc_id"]: [s["value"] for s in r["_term"]] for r in found}
    assert all(terms[k] == ["zorblatt"] for k in range(4)) and not any(terms[i] for i in terms if i >= 4)
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert all("ask [TERM] at [EMAIL] today" in texts[k] for k in range(4))
    assert texts[200] is None and all(texts[i] == t for i, t, _ in rows[4:])


def test_terms_of_rare_entities_are_masked_in_the_whole_document(spark):
    far = " ".join(prose(1, 60, 50))
    rows = [(k, f"Quillfeather wrote. {far} mail quill@corp.com {far} so quillFEATHER left in {k}", "s") for k in range(2)]
    rows += [(2, f"Brimble {far} or brim@corp.com", "s"), (3, f"{far} Tonk and wrote", "s")]
    rows += [(10 + k, " ".join(prose(k, 40, 50)) + " wrote mail so left in or and 0 1", "s") for k in range(1500)]
    texts = {r["doc_id"]: r["text"] for r in pii.sanitise(table(spark, rows)).collect()}
    # Entities of two documents and of one; the names stand more than 80 characters off.
    assert all(texts[k] == f"[TERM] wrote. {far} mail [EMAIL] {far} so [TERM] left in {k}" for k in range(2))
    assert texts[2] == f"[TERM] {far} or [EMAIL]"
    assert all(texts[i] == t for i, t, _ in rows[3:])


# 9


def test_segments_are_those_of_the_definition():
    rng = np.random.default_rng(5)
    for _ in range(300):
        places = sorted(rng.choice(60, rng.integers(0, 12), replace=False).tolist())
        scores = [(p, float(rng.integers(-3, 4)) + 0.5) for p in places]
        line = [-toxicity.NEUTRAL] * 60
        for p, s in scores:
            line[p] = s

        def split(lo, hi):
            """The best segment first (shortest, then leftmost), then what is left of it and right of it."""
            best = max(((round(sum(line[i : j + 1]), 9), -(j - i), -i) for i in range(lo, hi) for j in range(i, hi)), default=(0, 0, 0))
            if best[0] <= 1e-9:
                return []
            i, j = -best[2], -best[2] - best[1]
            return split(lo, i) + [(i, j)] + split(j + 1, hi)

        assert [(a, b) for a, b, _ in toxicity.segments(scores)] == split(0, 60)


def test_toxicity_on_held_out_rows(spark):
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for k in range(1200):
        w = prose(k, int(rng.integers(20, 200)), 800)
        bad = k % 8 == 0
        for at in rng.integers(0, len(w), 4 if bad else 0):
            w[at] = ["vile", "dreckig", "foulmouth"][at % 3]
        rows.append((k, " ".join(w), "s"))
        labels.append((k, 1, int(bad)))
    docs, given = table(spark, rows + [(9000, None, "s"), (9001, "", "s"), (None, "vile vile vile", "s")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, given).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 9000]
    assert len(held) > 200 and sum(r["predicted"] == (r["doc_id"] % 8 == 0) for r in held) >= 0.98 * len(held)
    assert len(got) == 1203 and all(0 <= r["score"] <= 1 for r in got)
    found = next(r for r in got if r["doc_id"] is None)
    assert found["predicted"] == 1 and not found["held_out"] and found["passages"]
    alone = toxicity.toxicity(table(spark, ODD), given.limit(0)).collect()
    assert len(alone) == len(ODD)
    assert toxicity.toxicity(table(spark, []), given).count() == 0


# 10


def plain_shortened(rows):
    seen, gone = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        w = tokens(text)
        gone[i] = set()
        for p in range(len(w) - 19):
            if seen.setdefault(tuple(w[p : p + 20]), (i, p)) != (i, p):
                gone[i].update(range(p, p + 20))
    return {i: (len(tokens(t)), len(gone[i]), " ".join(x for k, x in enumerate(tokens(t)) if k not in gone[i])) for i, t in rows}


@pytest.mark.parametrize("chunk", [1 << 20, 200])
def test_substrings_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 4000)
    shared = prose(1, 70, 5000)
    rows = []
    for k in range(60):
        own = prose(100 + k, 90, 5000)
        at, lo = k % 50, k % 30
        rows.append((k, " ".join(own[:at] + shared[lo : lo + 15 + k % 40] + own[at:]), "s"))
    rows += [(200, rows[3][1], "s"), (201, "la " * 100, "s"), (202, None, "s"), (203, "", "s"), (204, "short", "s"), (205, " ".join(shared), "s")]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.deduplicated(table(spark, rows), F.col("kept")).collect()}
    assert got == plain_shortened([(i, t) for i, t, _ in rows])


def test_substrings_of_odd_rows(spark):
    long = " ".join(prose(1, 50, 5000))
    got = substrings.deduplicated(table(spark, [(7, long, "s"), (7, long, "s"), (None, long, "s"), *ODD]), F.col("kept")).collect()
    assert len(got) == 3 + len(ODD)
    assert [r["n_removed"] for r in got if r["doc_id"] == 7] == [0, 0]
    assert sum(r["n_removed"] for r in got if r["doc_id"] is None) == 50
    assert substrings.deduplicated(table(spark, []), F.col("kept")).count() == 0


# The pipeline


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rows = [(k, " ".join(prose(k, 40)).capitalize() + ".", "a") for k in range(30)] + ODD + [(77, "mail me at a.b@c.de " + " ".join(prose(7, 30)), "b")]
    for name, frame in {
        "documents": spark.createDataFrame([(i, t, "en", s, len(t or ""), "more") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, row string"),
        "labels": spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, " ".join(prose(25, 40)))], "item_id long, text string"),
    }.items():
        frame.write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in out}
    assert 25 not in ids and 24 in ids and not any("@" in (r["text"] or "") for r in out)
    assert all(r["n_chars"] == len(r["text"]) for r in out if r["text"])
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).limit(0).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
