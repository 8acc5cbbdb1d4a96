"""Personal data: four kinds found by pattern, and the terms that would give the same person away."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingualoom.llm.words import let
from lingualoom.session import discard, stage

# The kinds in order, as patterns.  Quantifiers are possessive and starts are tied to the
# beginning of a run, which finds the same matches in one pass over long runs.
_LOCAL, _LABEL = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Only runs of at least 16 digits, each with one blank or hyphen before it at most.
    "card": r"(?<![0-9])(?<![0-9][\x20-])(?=(?:[0-9][\x20-]?){15}[0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
NEEDS = {"email": "@", "ip": ".", "card": "0", "phone": "+"}
TERM = "term"
# Documents without the entity's information that a term's documents are mixed with, which lowers the information of
# rare pairs, and the share of the entity's information that a term may reveal.
PRIOR = 1.0
DISCLOSED = 0.9
# Standard errors that are taken off the number of common documents, unless term and mention begin alike.
BOUND = 1.2816
ALIKE = 4
_SPAN = "array<struct<start:int,stop:int,value:string>>"
_WORD = r"[\p{L}\p{N}]"


def _located(text: Column, pattern: str | Column) -> Column:
    """All matches with their places in code points, end exclusive.

    What stands between the matches is as long as the text without them, so the places are sums of
    lengths.
    """
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("found"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        stop = start + F.length(pair["value"])
        one = F.struct(start.alias("start"), stop.alias("stop"), pair["value"].alias("value"))
        return F.struct(stop.alias("at"), F.concat(acc["found"], F.array(one)).alias("found"))

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def summed(values: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        pairs = F.zip_with(F.slice(gaps, 1, F.size(values)), values, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
        return F.aggregate(pairs, zero, step, lambda acc: acc["found"])

    return let(matches, lambda values: F.when(F.size(values) > 0, summed(values)).otherwise(F.array().cast(_SPAN)))


def _small_parts(value: Column) -> Column:
    def small(part: Column) -> Column:
        digits = F.regexp_replace(part, "^0+(?=[0-9])", "")
        return (F.length(digits) <= 3) & (F.lpad(F.substring(digits, 1, 3), 3, "0") <= "255")

    return F.forall(F.split(value, r"\."), small)


def _luhn(value: Column) -> Column:
    """16 to 19 digits with a sum divisible by 10, where every second digit from the right counts double."""
    digits = F.regexp_replace(value, "[^0-9]", "")

    def total(d: Column) -> Column:
        def worth(i: Column) -> Column:
            x = F.ascii(F.substr(d, F.length(d) - i, F.lit(1))) - 48
            twice = x * 2
            return F.when(i % 2 == 0, x).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

        return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda s, i: s + worth(i))

    return let(digits, lambda d: F.length(d).between(16, 19) & F.when(F.length(d).between(16, 19), total(d) % 10 == 0).otherwise(False))


def _digit_count(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: F.lit(True),
    "ip": _small_parts,
    "card": _luhn,
    "phone": lambda v: _digit_count(v).between(8, 15),
}


def spans(text: Column, kind: str) -> Column:
    """``array<struct<start, stop, value>>``: leftmost matches that don't overlap and pass the kind's check."""
    none = F.array().cast(_SPAN)
    found = F.filter(_located(text, PATTERNS[kind]), lambda s: CHECKS[kind](s["value"]))
    maybe = F.contains(text, F.lit(NEEDS[kind])) if kind != "card" else F.lit(True)
    return F.when(maybe, found).otherwise(none)


def listed(found: Column, kind: str) -> Column:
    """``kind:start:stop`` of each span, in order."""
    return F.transform(found, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["stop"].cast("string")))


def base_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with an array column ``_email``, ``_ip``, ``_card`` and ``_phone`` each."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({f"_{kind}": spans(text, kind) for kind in KINDS})


def _text_key(text: Column) -> tuple[Column, Column]:
    full = F.coalesce(text, F.lit(""))
    return F.xxhash64(full).alias("k1"), F.xxhash64(F.lit(7), full).alias("k2")


def _words(text: Column) -> Column:
    """The distinct words of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"{_WORD}++"), F.lit(0)))


def _terms(text: Column) -> Column:
    """The distinct words in lower case."""
    return F.array_distinct(F.transform(_words(text), F.lower))


def _without(text: Column, base: Column) -> Column:
    """The text with a blank for each mention."""
    return _replaced(text, F.transform(base, lambda s: F.struct(s["start"], s["stop"], F.lit(" ").alias("kind"))), lambda kind: kind)


def mentions(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``k1, k2, entity`` for each text and what it mentions, and ``k1, k2, term, alike`` for each of its words outside mentions.

    ``alike`` says whether some word of a mention begins with the same ALIKE letters.
    """
    base = F.concat(*[F.col(f"_{k}") for k in KINDS])
    entities = found.select("k1", "k2", F.explode(F.array_distinct(F.transform(base, lambda s: F.lower(s["value"])))).alias("entity"))
    inside = F.array_join(F.transform(base, lambda s: F.lower(s["value"])), " ")
    begins = F.array_distinct(F.regexp_extract_all(inside, F.lit(rf"(?<!\p{{L}})\p{{L}}{{{ALIKE}}}"), F.lit(0)))

    def marked(begins: Column) -> Column:
        return F.transform(_terms(_without(F.col("t"), base)), lambda w: F.struct(w.alias("term"), F.array_contains(begins, F.left(w, F.lit(ALIKE))).alias("alike")))

    return entities, found.select("k1", "k2", F.inline(let(begins, marked)))


def disclosing(docs: DataFrame, entities: DataFrame, terms: DataFrame, text_col: str, disclosed: float = DISCLOSED) -> DataFrame:
    """``k1, k2, terms``: of each text, the words that reveal at least ``disclosed`` of the information of an entity in it.

    With N documents, an entity in n of them carries ``log(N / n)``; a term in m of them, c with the
    entity, reveals ``log(c N / (n m))``, the pointwise mutual information, after Sanchez and
    Batet.  c and m are counts of whole documents, and c / m is mixed with PRIOR documents at the
    rate n / N, so that little evidence counts less.  Of c, BOUND standard errors are taken off first, so a word
    does not disclose by being unique: only one that begins like the mention (a name and its address) may occur
    with it once, and then needs about a thousand documents around it.  Equal texts count as often as they occur.  Entities of the same texts have
    the same terms and are judged as one, so a long list of addresses does not multiply its words.
    """
    # Copies are counted before they meet anything, so a text that very many documents share is few rows.
    copies = docs.select(*_text_key(F.col(text_col))).groupBy("k1", "k2").agg(F.count("*").alias("copies"))
    copies = stage(copies.join(entities.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi"), "pii-copies")
    size = F.lit(float(max(docs.count(), 1)))
    entities = entities.join(copies, ["k1", "k2"])
    known = entities.groupBy("entity").agg(F.sum("copies").alias("n"), F.bit_xor(F.xxhash64("k1", "k2")).alias("set"))
    # An entity of all documents has no information.
    known = known.filter(F.col("n") < size).select("entity", "n", F.xxhash64("n", "set").alias("group"))
    groups = stage(entities.join(known, "entity").select("k1", "k2", "copies", "group", "n").distinct(), "entity-groups")

    def reveals(c: Column, m: Column) -> Column:
        rate = F.col("n") / size
        c = F.when(F.col("alike"), c.cast("double")).otherwise(F.greatest(c - BOUND * F.sqrt(c), F.lit(0.0)))
        return F.log((c + PRIOR * rate) / (m + PRIOR) / rate) >= F.log(1 / rate) * disclosed

    seen = docs.select(F.explode(_terms(F.coalesce(F.col(text_col), F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("m"))
    seen = stage(seen.join(terms.select("term").distinct(), "term", "left_semi"), "terms")
    # c is at most n and m, so what fails with that has no need to be counted.
    pairs = terms.join(seen, "term").join(groups, ["k1", "k2"]).filter(reveals(F.least("n", "m"), F.col("m")))
    pairs = stage(pairs, "entity-terms")
    counted = pairs.groupBy("group", "term").agg(F.sum("copies").alias("c"), F.first("n").alias("n"), F.first("m").alias("m"), F.max("alike").alias("alike"))
    counted = counted.filter(reveals(F.col("c"), F.col("m"))).select("group", "term")
    result = pairs.join(counted, ["group", "term"]).groupBy("k1", "k2").agg(F.collect_set("term").alias("terms"))
    result = stage(result, "disclosing")
    discard(copies, groups, seen, pairs)
    return result


def _term_spans(text: Column, base: Column, terms: Column) -> Column:
    """All places of the terms as whole words that no mention covers."""

    def located(forms: Column) -> Column:
        pattern = F.concat(F.lit(rf"(?<!{_WORD})(?:"), F.array_join(forms, "|"), F.lit(rf")(?!{_WORD})"))
        return F.when(F.size(forms) > 0, _located(text, pattern)).otherwise(F.array().cast(_SPAN))

    def free(found: Column) -> Column:
        return F.filter(found, lambda s: ~F.exists(base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))

    forms = F.filter(_words(text), lambda w: F.array_contains(terms, F.lower(w)))
    lower = lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lower(s["value"]).alias("value"))
    return let(forms, lambda f: F.transform(free(located(f)), lower))


def sanitised_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``k1, k2`` and the spans of each distinct text that has any: ``_email`` to ``_phone`` and ``_term``.

    The patterns find the four kinds; a term that discloses an entity becomes a span too, wherever it stands
    in a text that mentions the entity, unless another span covers it.  A text without mentions has no spans at all.
    Null is an empty text, empty texts and tables have none.
    """
    found = base_spans(docs.select(*_text_key(F.col(text_col)), F.col(text_col).alias("t")), "t")
    some = F.greatest(*[F.size(f"_{k}") for k in KINDS]) > 0
    # Documents without any are dropped before the shuffle; of equal texts one is kept.
    row = F.struct("t", *[f"_{k}" for k in KINDS])
    found = found.select("k1", "k2", row.alias("row"), some.alias("some")).filter("some")
    found = stage(found.groupBy("k1", "k2").agg(F.max("row").alias("row")).select("k1", "k2", "row.*"), "pii-texts")
    entities, terms = (stage(df, "pii-mentions") for df in mentions(found))
    chosen = disclosing(docs, entities, terms, text_col)
    base = F.concat(*[F.col(f"_{k}") for k in KINDS])
    result = found.join(chosen, ["k1", "k2"], "left").select(
        "k1", "k2", *[f"_{k}" for k in KINDS], F.coalesce(_term_spans(F.col("t"), base, F.col("terms")), F.array().cast(_SPAN)).alias("_term")
    )
    result = stage(result, "pii-spans")
    discard(found, entities, terms, chosen)
    return result


def with_spans(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns in ``keep``, else all), and ``_email`` to ``_term`` for each row of ``docs``."""
    found = sanitised_spans(docs, text_col)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), *_text_key(F.col(text_col)))
    none = F.array().cast(_SPAN)
    joined = keyed.join(found, ["k1", "k2"], "left")
    return joined.select("row", *[F.coalesce(f"_{k}", none).alias(f"_{k}") for k in (*KINDS, TERM)])


def _replaced(text: Column, all_spans: Column, put: Callable[[Column], Column]) -> Column:
    """The text with ``put(kind)`` for each span; overlapping spans are one, from the first start to the last stop, with the kind of the longest."""
    empty = F.lit(None).cast("int")
    zero = F.struct(
        F.lit(0).alias("at"), empty.alias("start"), empty.alias("stop"), F.lit(None).cast("string").alias("kind"), F.lit(0).alias("size"),
        F.array().cast("array<string>").alias("parts"),
    )

    def done(acc: Column) -> Column:
        """What stands before the span in hand, and what is put in its place."""
        made = F.concat(acc["parts"], F.array(F.substr(text, acc["at"] + 1, acc["start"] - acc["at"]), put(acc["kind"])))
        return F.when(acc["start"].isNull(), acc["parts"]).otherwise(made)

    def step(acc: Column, s: Column) -> Column:
        size = s["stop"] - s["start"]
        joined = F.struct(
            acc["at"].alias("at"), acc["start"].alias("start"), F.greatest(acc["stop"], s["stop"]).alias("stop"),
            F.when(size > acc["size"], s["kind"]).otherwise(acc["kind"]).alias("kind"), F.greatest(acc["size"], size).alias("size"), acc["parts"].alias("parts"),
        )
        fresh = F.struct(
            F.coalesce(acc["stop"], F.lit(0)).alias("at"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"), size.alias("size"),
            done(acc).alias("parts"),
        )
        return F.when(F.coalesce(s["start"] < acc["stop"], F.lit(False)), joined).otherwise(fresh)

    def end(acc: Column) -> Column:
        return F.array_join(F.concat(done(acc), F.array(F.substr(text, acc["stop"] + 1, F.length(text)))), "")

    return F.when(F.size(all_spans) > 0, F.aggregate(F.array_sort(all_spans), zero, step, end)).otherwise(text)


def masked(text: Column, all_spans: Column) -> Column:
    """The text with each span replaced by its kind; overlapping spans are replaced as one, by the kind of the longest.

    ``all_spans`` are ``array<struct<start, stop, kind>>``.  Numbers among the terms are generalised to
    ``[NUMBER]``, other terms removed as ``[TERM]``.
    """
    return _replaced(text, all_spans, lambda kind: F.concat(F.lit("["), F.upper(kind), F.lit("]")))


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data and disclosing terms in the text column replaced by their kind.

    Null texts stay null.  All other columns are kept as they are.
    """
    found = with_spans(docs, text_col)

    def tagged(kind: str) -> Column:
        def one(s: Column) -> Column:
            name = F.when(s["value"].rlike("^[0-9]+$"), "number").otherwise(kind) if kind == TERM else F.lit(kind)
            return F.struct(s["start"].alias("start"), s["stop"].alias("stop"), name.alias("kind"))

        return F.transform(f"_{kind}", one)

    text = masked(F.col("row")[text_col], F.concat(*[tagged(k) for k in (*KINDS, TERM)]))
    return found.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
