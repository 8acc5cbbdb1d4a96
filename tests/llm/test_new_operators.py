"""Neighbours, spelling variants and tokenizer alignment against brute force, and on odd rows and empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lingualoom.llm import alignment, neighbours, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, n long, k1 long, groups string"


def documents(spark, rows):
    """Documents with columns of clashing names."""
    return spark.createDataFrame([(i, t, "en", "s", 1, "w", 2, 3, "g") for i, t in rows], DOCS)


# 11

VECTORS = "vec_id long, embedding array<{}>, label int, score double, near string"


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 0, 0.0, "x") for i, v in rows], VECTORS.format(kind))


def nearest(rows, k=20, every=20):
    """Every row against every other, by pairs."""
    out = {}
    for q, (i, v) in enumerate(rows):
        if i % every == 0:
            near = [(-math.fsum(a * b for a, b in zip(v, w, strict=True)), j) for c, (j, w) in enumerate(rows) if c != q]
            out[i] = [j for _, j in sorted(near)[:k]]
    return out


def found(table, **options):
    got = defaultdict(list)
    for r in sorted(neighbours.neighbours(table, **options).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append(r["vec_id"])
        assert r["rank"] == len(got[r["query_id"]])
    return got


def test_neighbours_reach_the_recall_with_vectors_of_unlike_length(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 24))
    rows = [(i, [float(np.float32(x)) for x in (centres[i % 30] + 0.4 * rng.standard_normal(24)) * rng.uniform(0.5, 2)]) for i in range(3000)]
    want = nearest(rows)
    for slice_rows in (1 << 16, 300):
        got = found(vectors(spark, rows), slice_rows=slice_rows)
        assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
        assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9


def test_neighbours_of_copies_ties_and_few_rows(spark):
    rng = np.random.default_rng(5)
    same = [1.0, 2.0, 0.0]
    rows = [(i, same) for i in range(0, 300, 2)] + [(i, rng.standard_normal(3).tolist()) for i in range(1, 100, 2)]
    got = found(vectors(spark, rows, "double"))
    want = nearest(rows)
    copies = [q for q in want if dict(rows)[q] == same]
    assert len(copies) == 15 and all(len(got[q]) == 20 for q in want)
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9
    few = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (7, [1.0, 1.0])]
    assert found(vectors(spark, few)) == {0: [7, 20], 20: [7, 0]}


def test_neighbours_leave_unusable_rows_out(spark):
    odd = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
           (7, [None, 1.0]), (8, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (20, None), (9, [-1.0, 0.0]), (9, [-1.0, 0.0])]
    assert found(vectors(spark, odd)) == {0: [1, 9]}
    assert neighbours.neighbours(vectors(spark, [])).count() == 0
    assert neighbours.neighbours(vectors(spark, [(1, [1.0, 2.0])])).count() == 0


# 12


def variants(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        long, short = (a, b) if len(a) > len(b) else (b, a)
        return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))

    pairs = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, others in pairs.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= 2 * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(pairs[w]), n.get(form.get(w)))
    return out


def test_variants_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    stems = ["".join(rng.choice(list("abcé"), rng.integers(5, 9))) for _ in range(60)]
    rows = []
    for i in range(400):
        words = [stems[int(60 * rng.random() ** 3)] for _ in range(40)]
        for k in range(len(words)):
            if rng.random() < 0.2:
                at = rng.integers(0, len(words[k]))
                words[k] = words[k][:at] + rng.choice(["", "a", "ë", "Z"]) + words[k][at + int(rng.integers(0, 2)) :]
        rows.append((i, " ".join(words)))
    rows += [(None, "Wärme wärme WÄRME warme warme Warme"), (500, None), (501, ""), (502, "×÷×÷×÷×÷"), (503, " 12 "), (1, "aaaaa aaaa"), (1, "aaaaa aaaa")]
    # A form that has a form itself.
    rows += [(None, "stonexx " * 3 + "stonex " * 6 + "stone " * 12)]
    long = "abcdefghij" * 700
    rows += [(600 + k, f"{long} {long[:-1]} {long}") for k in range(4)]
    got = {r[0]: tuple(r)[1:] for r in spelling.variants(documents(spark, rows)).collect()}
    want = variants(rows)
    assert got == want and sum(v[0] is not None for v in want.values()) > 20
    assert max(len({w, v[0], v[1]} - {None}) for w, v in want.items()) == 3
    assert spelling.variants(documents(spark, [])).count() == 0


def test_a_small_filter_loses_nothing(spark, monkeypatch):
    words = spark.createDataFrame([(f"{a}{b}wor{c}d", 3) for a in "abcdef" for b in "uvwxyz" for c in "klm"], "word string, n long")
    want = {tuple(r) for r in spelling.near_pairs(words).collect()}
    of = spelling.Shards.of
    monkeypatch.setattr(spelling.Shards, "of", lambda sizes: of(sizes, 64))
    assert {tuple(r) for r in spelling.near_pairs(words).collect()} == want and len(want) == (108 * (5 + 5 + 2)) // 2


# 13


def aligned(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(alignment.A_FILE), SentencePieceProcessor(model_file=alignment.B_FILE)
    first.encode_special_tokens = True
    letter = {c: b for c, b in alignment._byte_of().items()}
    docs, counts = [], Counter()
    for i, text in rows:
        found = None
        if text:
            a = first.encode(" " + text, add_special_tokens=False).ids
            b = second.encode(text)
            parts = [bytes(letter[c] for c in first.id_to_token(x)) for x in a]
            pieces = [second.id_to_piece(x) for x in b]
            pieces = [bytes([int(p[3:5], 16)]) if second.is_byte(x) else p.replace("▁", " ").encode() for p, x in zip(pieces, b, strict=True)]
            if b"".join(parts) == b"".join(pieces) == (" " + text).encode():
                ends = [np.cumsum([len(p) for p in side]).tolist() for side in (parts, pieces)]
                links = [
                    (x, y) for j, x in enumerate(a) for k, y in enumerate(b)
                    if max(ends[0][j] - len(parts[j]), ends[1][k] - len(pieces[k])) < min(ends[0][j], ends[1][k])
                ]
                groups, start = [], [0, 0]
                for e in sorted(set(ends[0]) & set(ends[1])):
                    stop = [ends[0].index(e) + 1, ends[1].index(e) + 1]
                    groups.append(",".join(map(str, a[start[0] : stop[0]])) + "|" + ",".join(map(str, b[start[1] : stop[1]])))
                    start = stop
                found = (len(a), len(b), len(groups), links, ";".join(groups))
                counts.update(set(links))
        docs.append((i, found))
    top = defaultdict(int)
    for (x, _), c in counts.items():
        top[x] = max(top[x], c)
    out = Counter()
    for i, d in docs:
        if d is None:
            out[(i, 0, 0, 0, 0, 0, 0, "")] += 1
        else:
            best = sum(counts[x] == top[x[0]] for x in d[3])
            out[(i, d[0], d[1], d[2], len(d[3]), best, sum(counts[x] for x in d[3]), d[4])] += 1
    return out


TEXTS = [
    (1, "The quick brown fox"), (2, "the quicker browner foxes, naïve café"), (3, None), (4, ""), (5, "  two  blanks \n\n\ttab "), (6, "▁ lower block"),
    (7, "<|endoftext|> and </s> are text"), (8, "日本語 и русский 😀"), (9, "The quick brown fox"), (None, "The quick brown fox"), (9, "The quick brown fox"),
    (10, "word " * 3000), (11, "\x00\x01 controls"), (12, " "), (13, "é combining ﬁ"),
]


def test_alignment_equals_brute_force(spark):
    rows = [r for r in TEXTS if r[0] != 10] + [(10, "word " * 60)]
    got = Counter(map(tuple, alignment.aligned_texts(documents(spark, rows)).collect()))
    assert got == aligned(rows)
    assert next(r for r in got if r[0] == 6)[1:] == (0, 0, 0, 0, 0, 0, "")
    digests = {(r["doc_id"], r["groups"]) for r in alignment.aligned_texts(documents(spark, rows), digest=True).collect()}
    assert digests == {(r[0], hashlib.sha256(r[-1].encode()).hexdigest() if r[1] else "") for r in got}
    assert alignment.aligned_texts(documents(spark, [])).count() == 0


def test_alignment_in_small_chunks_is_the_same(spark, monkeypatch):
    whole = Counter(map(tuple, alignment.aligned_texts(documents(spark, TEXTS)).collect()))
    monkeypatch.setattr(alignment, "CHUNK", 10)
    monkeypatch.setattr(alignment, "HELD", 5)
    assert Counter(map(tuple, alignment.aligned_texts(documents(spark, TEXTS)).collect())) == whole
    pairs = alignment.pair_counts(documents(spark, TEXTS)).collect()
    assert len({(r["a_id"], r["b_id"]) for r in pairs}) == len(pairs)
    tops = defaultdict(int)
    for r in pairs:
        tops[r["a_id"]] = max(tops[r["a_id"]], r["n"])
    assert all(r["best"] == (r["n"] == tops[r["a_id"]]) for r in pairs)


def test_both_encoders_agree_on_plain_texts():
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(alignment.A_FILE)
    slow.encode_special_tokens = True
    chars = [chr(c) for c in (*range(0x250), *range(0x2010, 0x2028), 0x20AC)]
    rng = np.random.default_rng(8)
    texts = [t for c in chars for t in (c, f"a{c}b", c + c + " " + c, f" {c}1", f"  {c}  x", f"{c}\n\n{c}", f"it{c}s 'll{c}")]
    texts += ["".join(rng.choice(chars + list(" et1\n'") * 60, rng.integers(1, 40))) for _ in range(3000)] + ["a" * 5000]
    assert all(alignment.PLAIN.fullmatch(t) for t in texts)
    got = alignment.tokenizers(alignment.A_FILE, alignment.B_FILE).a.encode(texts)
    assert got == [e.ids for e in slow.encode_batch([" " + t for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", ["neighbours", "spelling", "alignment"])
def test_docstrings_define_the_odd_cases(name):
    module = {"neighbours": neighbours.neighbours, "spelling": spelling.variants, "alignment": alignment.aligned_texts}[name]
    assert "ull" in module.__doc__ and "empty table" in module.__doc__


# Personal data


def test_overlapping_mentions_leave_nothing_of_either(spark):
    from lingualoom.llm import pii

    rows = [(0, "mail +491701234567@mail.de or 1.2.3.4@corp.com bye"), (1, "+491.23456789.smith@x.com"), (2, "no data")]
    assert [r["text"] for r in pii.sanitise(documents(spark, rows)).orderBy("doc_id").collect()] == ["mail [EMAIL] or [EMAIL] bye", "[EMAIL]", "no data"]


def test_unique_words_do_not_disclose_by_themselves(spark):
    from lingualoom.llm import pii

    book = " ".join(f"w{k}" for k in range(16_000))
    rows = [(0, f"Halvorsen {book} halvor@corp.com end")] + [(1 + k, f"plain words {k % 7} of no one") for k in range(2990)]
    texts = {r["doc_id"]: r["text"] for r in pii.sanitise(documents(spark, rows)).filter("doc_id < 3").collect()}
    assert texts[0] == f"[TERM] {book} [EMAIL] end" and texts[1] == rows[1][1]
