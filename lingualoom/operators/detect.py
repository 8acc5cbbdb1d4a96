"""Source language of documents: scripts decide first, a trigram profile between Latin languages."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingualoom.functions import chars as C
from lingualoom.functions import protect as P
from lingualoom.functions import text as X
from lingualoom.operators.spread import running_start

# ---- fixed values: detection thresholds ----------------------------------------------------------
MAX_SAMPLE = 20_000
MIN_HAN = 10
MIN_LATIN = 20
KANA_SHARE = 0.10
MIN_CONFIDENCE = 0.70
# ---- end of fixed values -------------------------------------------------------------------------

# A profile counts trigrams in hashed slots; a slot that a language has less often than this says nothing about it.
SLOTS = 1 << 16
LEAST_COUNT = 5
# Labelled texts that the profile of ``detect_source`` and ``detect_accuracy`` is learned from at most: those with the smallest MD5.
PROFILE_ROWS = 20_000
# Log weights are whole thousandths, so that sums do not depend on the order of addition.
WEIGHT_SCALE = 1000
# Characters that are scored at once.
CHUNK_CHARS = 1 << 18


def detect_sample(segments: DataFrame, text: str = "line", size: int = MAX_SAMPLE) -> DataFrame:
    """The first ``size`` characters of each document, as chunks of its segments in order.

    Works on segment tables from any source.  A document of any length is accumulated by spans of
    positions and never sorted in one task (see ``running_start``).
    """
    placed = running_start(segments, ["doc_id"], "seg_no", F.length(text))
    return placed.filter(F.col("start") < size).withColumn(
        "chunk", F.substring(F.col(text), F.lit(1), (size - F.col("start")).cast("int"))
    )


def sample_of(text: Column, size: int = MAX_SAMPLE) -> Column:
    """The same sample when the whole document is in the row: no shuffle at all."""
    lines = F.filter(F.split(text, C.LINE_BREAK, -1), lambda s: ~X.is_blank(s))
    return F.left(F.array_join(F.transform(lines, P.outside_spans), "\n"), F.lit(size))


def script_counts(text: Column) -> list[Column]:
    return [
        X.count_class(text, C.KANA).alias("kana"),
        X.count_class(text, C.HAN).alias("han"),
        X.count_latin(text).alias("latin"),
    ]


def script_histogram(chunks: DataFrame, text: str = "chunk") -> DataFrame:
    """Kana, Han and Latin letters per document."""
    counted = chunks.select("doc_id", *script_counts(F.col(text)))
    return counted.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("kana", "han", "latin")])


def rule_columns() -> list[Column]:
    """lang, note and error_code from kana, han and latin; Latin text still awaits the profile."""
    kana, han, latin = F.col("kana"), F.col("han"), F.col("latin")
    nothing = kana + han + latin == 0
    cjk = kana + han >= latin
    is_ja = kana >= KANA_SHARE * (kana + han)
    lang = F.when(nothing, F.lit(None)).when(cjk & is_ja, F.lit("ja")).when(
        cjk & (han >= MIN_HAN), F.lit("zh")
    )
    note = F.when(
        ~nothing & cjk & ~is_ja & (han >= MIN_HAN), F.lit("detected_without_kana")
    )
    error = F.when(
        ~nothing & ((cjk & ~is_ja & (han < MIN_HAN)) | (~cjk & (latin < MIN_LATIN))),
        F.lit("source_ambiguous"),
    )
    return [
        lang.cast("string").alias("lang"),
        note.alias("note"),
        error.alias("error_code"),
        (~nothing & ~cjk & (latin >= MIN_LATIN)).alias("latin_open"),
    ]


def detect_rule(histogram: DataFrame) -> DataFrame:
    return histogram.select("*", *rule_columns())


def _slots_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The slots of the overlapping trigrams of lower-cased texts, text by text, and how many each has."""
    size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    slots = (codes[:-2] * 961 + codes[1:-1] * 31 + codes[2:]) % SLOTS if len(codes) > 2 else codes[:0]
    return slots[owner[2:] == owner[:-2]] if len(slots) else slots, np.maximum(size - 2, 0)


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """From where to where texts are worked on at once: CHUNK_CHARS characters, or one text that is longer."""
    size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // CHUNK_CHARS, prepend=-1))
    return zip(cuts, np.append(cuts, len(texts))[1:], strict=True)


def _slot_counts(texts: DataFrame, languages: Sequence[str]) -> DataFrame:
    """lang, slot, n: the overlapping trigrams of lower-cased texts, added up for each task; a task holds SLOTS numbers for each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), SLOTS), dtype=np.int64)
        for batch in batches:
            for i, code in enumerate(languages):
                some = pc.fill_null(batch.column(1).filter(pc.equal(batch.column(0), code)), "")
                for a, b in _pieces(some):
                    counts[i] += np.bincount(_slots_of(some[a:b])[0], minlength=SLOTS)
        lang, slot = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(languages, pa.string()).take(pa.array(lang)), pa.array(slot.astype(np.int32)), pa.array(counts[lang, slot])], ["lang", "slot", "n"]
        )

    return texts.mapInArrow(run, "lang string, slot int, n long")


def latin_profile(
    labelled: DataFrame, lang: str, text: str, languages: Sequence[str], least: int = LEAST_COUNT, rows: int | None = None
) -> DataFrame:
    """slot, weights: the log share of each slot's trigrams in every language.

    A profile is a model of a stated size, SLOTS rows at most, learned from every labelled text, or from ``rows``
    at most if that is given; every trigram of theirs is counted, and a slot counts for a language from ``least`` on.
    """
    wanted = labelled.filter(F.col(lang).isin(*languages))
    if rows is not None:
        mark = F.md5(text)
        last = wanted.select(mark.alias("_h")).orderBy("_h").limit(rows).agg(F.max("_h")).first()[0]
        wanted = wanted.filter(mark <= F.lit(last))
    counts = (
        _slot_counts(wanted.select(F.col(lang).alias("lang"), F.lower(text).alias("text")), languages)
        .groupBy("lang", "slot")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= least)
    )
    per_slot = counts.groupBy("slot").agg(
        *[F.max(F.when(F.col("lang") == code, F.col("n"))).alias(f"n_{i}") for i, code in enumerate(languages)]
    )
    totals = counts.groupBy().agg(
        *[F.sum(F.when(F.col("lang") == code, F.col("n"))).alias(f"t_{i}") for i, code in enumerate(languages)]
    )
    # One row of totals.
    both = per_slot.crossJoin(F.broadcast(totals))
    log_share = lambda i: F.log(F.coalesce(F.col(f"n_{i}").cast("double"), F.lit(0.5)) / F.col(f"t_{i}"))
    return both.select("slot", *[F.round(log_share(i) * WEIGHT_SCALE).cast("int").alias(f"w_{i}") for i in range(len(languages))])


def latin_confidence(
    samples: DataFrame, keys: list[str], text: str, profile: DataFrame, languages: Sequence[str]
) -> DataFrame:
    """keys, best, confidence: softmax over the summed log weights of a sample's trigrams.

    Samples are scored a batch at a time: the profile, whose size is stated where it is made, is one
    array that goes with the task, and no trigram becomes a row.  A row without a known trigram keeps its keys and gets NULLs.
    """
    n = len(languages)
    # At most SLOTS rows.
    weights = np.zeros((SLOTS, n), dtype=np.int64)
    for r in profile.collect():
        weights[r["slot"]] = [r[f"w_{i}"] or 0 for i in range(n)]

    def sums(lowered: pa.Array) -> pa.Array:
        """The summed weights of each text, a bounded number of characters at a time."""
        texts = pc.fill_null(lowered, "")
        out = np.zeros((len(texts), n), dtype=np.int64)
        for a, b in _pieces(texts):
            slots, counts = _slots_of(texts[a:b])
            # Texts follow each other, so a text's sum is a difference of two running sums.
            upto = np.concatenate([np.zeros((1, n), dtype=np.int64), np.cumsum(weights[slots], axis=0)])
            ends = np.cumsum(counts)
            out[a:b] = upto[ends] - upto[np.append(0, ends[:-1])]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * n), pa.array(out.reshape(-1)))

    totals = F.arrow_udf(sums, "array<bigint>").asNondeterministic()(F.lower(text))
    scored = samples.select(*keys, totals.alias("_s")).withColumn("_s", F.when(F.exists("_s", lambda x: x != 0), F.col("_s")))
    best = F.array_max("_s")
    total = F.aggregate("_s", F.lit(0.0), lambda acc, s: acc + F.exp((s - best) / F.lit(float(WEIGHT_SCALE))))
    name = F.get(F.array(*map(F.lit, languages)), F.array_position("_s", best).cast("int") - 1)
    return scored.select(*keys, name.alias("best"), F.round(1 / total, 6).alias("confidence"))


def detect_source(
    docs: DataFrame, profile: DataFrame, languages: Sequence[str], text: str = "text"
) -> DataFrame:
    """doc_id, lang, confidence, note, error_code.  Ambiguity is a value, not an exception."""
    sampled = docs.select("doc_id", sample_of(F.col(text)).alias("sample"))
    ruled = sampled.select("doc_id", "sample", *script_counts(F.col("sample"))).select(
        "doc_id", "sample", *rule_columns()
    )
    keys = ["doc_id", "lang", "note", "error_code", "latin_open"]
    open_only = ruled.withColumn("sample", F.when(F.col("latin_open"), F.col("sample")))
    scored = latin_confidence(open_only, keys, "sample", profile, languages)
    sure = F.col("confidence") >= MIN_CONFIDENCE
    return scored.select(
        "doc_id",
        F.when(F.col("latin_open") & sure, F.col("best")).otherwise(F.col("lang")).alias("lang"),
        F.when(F.col("latin_open"), F.col("confidence")).alias("confidence"),
        "note",
        F.when(
            F.col("latin_open") & ~F.coalesce(sure, F.lit(False)), F.lit("source_ambiguous")
        ).otherwise(F.col("error_code")).alias("error_code"),
    )


# ---- accuracy ------------------------------------------------------------------------------------


def accuracy_samples(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """expected, kind, doc_id, n, sample: sentences, short prefixes, five-sentence documents, and
    Japanese without kana.  Lines are in their document's row, so five in a row need no window."""
    lines = F.filter(F.split(F.col(text), C.LINE_BREAK, -1), lambda s: ~X.is_blank(s))
    rows = docs.select("doc_id", F.col(lang).alias("expected"), lines.alias("lines"))
    cjk = F.col("expected").isin(*C.CJK_LANGUAGES)
    sentences = rows.select("expected", "doc_id", F.posexplode("lines").alias("n", "s"))
    words = F.array_join(F.slice(F.split(X.strip(F.col("s")), f"[{C.WS}]+", -1), 1, 3), " ")
    bare = X.strip(F.regexp_replace("s", f"[{C.KANA}]+", ""))
    from_lines = sentences.select(
        "expected", "doc_id", "n",
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit("sentence").alias("kind"), F.col("s").alias("sample")),
                    F.struct(
                        F.lit("short").alias("kind"),
                        F.when(cjk, F.left("s", F.lit(12))).otherwise(words).alias("sample"),
                    ),
                    F.struct(
                        F.lit("ja_without_kana").alias("kind"),
                        F.when((F.col("expected") == "ja") & (F.length(bare) >= 4), bare).alias(
                            "sample"
                        ),
                    ),
                ),
                lambda x: x["sample"].isNotNull(),
            )
        ).alias("x"),
    ).select("expected", "doc_id", "n", "x.kind", "x.sample")
    blocks = F.when(
        F.size("lines") > 5,
        F.transform(
            F.sequence(F.lit(0), F.size("lines") - 6, F.lit(5)),
            lambda i: F.array_join(F.slice(F.col("lines"), i + 1, 5), " "),
        ),
    )
    from_blocks = rows.select("expected", "doc_id", F.posexplode(blocks).alias("n", "sample"))
    return from_lines.unionByName(from_blocks.withColumn("kind", F.lit("document")))


def detect_accuracy(samples: DataFrame, profile: DataFrame, languages: Sequence[str]) -> DataFrame:
    """kind, expected, got, n by the plain rule: any kana is ja, Han without kana is zh."""
    keys = ["kind", "expected", "doc_id", "n"]
    counted = samples.select(*keys, "sample", *script_counts(F.col("sample")))
    cjk = (F.col("kana") + F.col("han") >= F.col("latin")) & (F.col("kana") + F.col("han") > 0)
    ruled = counted.select(
        *keys,
        F.when(cjk & (F.col("kana") > 0), F.lit("ja")).when(cjk, F.lit("zh")).alias("script"),
        F.when(~cjk & (F.col("latin") > 0), F.col("sample")).alias("sample"),
    )
    scored = latin_confidence(ruled, [*keys, "script"], "sample", profile, languages)
    return scored.groupBy(
        "kind", "expected", F.coalesce("script", "best").alias("got")
    ).agg(F.count("*").alias("samples"))
