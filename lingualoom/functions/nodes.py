"""Functions of a paragraph's nodes: one array per paragraph, worked on a batch of paragraphs at a time.

A paragraph's tree is an array in document order with kind ``text``, ``keep``, ``obj``, ``open`` or
``close``; a wrapper is an open and a close node, so no recursion is needed.  Everything here is a function of one
row, so a paragraph is never taken apart and regrouped.  The nodes of a batch lie in flat Arrow arrays, where each step is
one vector operation; functions that feed each other run in one Python call, without a way back through the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from lingualoom.functions import chars as C
from lingualoom.functions import tags as G

NODE = "struct<pos:int,kind:string,text:string,style:int,key:int>"
NODES = f"array<{NODE}>"
FIELDS = ("pos", "kind", "text", "style", "key")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also where lambdas read it."""
    return F.transform(F.array(value), body).getItem(0)


def _is_text(n: Column) -> Column:
    return n["kind"] == "text"


def visible_text(nodes: Column, kinds: tuple[str, ...] = ("text", "keep")) -> Column:
    """What is visible, or with ``("text",)`` what may be translated."""
    return F.array_join(F.transform(F.filter(nodes, lambda n: n["kind"].isin(*kinds)), lambda n: n["text"]), "")


def packed(nodes: Column) -> Column:
    """The same nodes where rows are shuffled: one array for each field takes half the bytes of an array of structs."""
    return F.struct(*[nodes.getField(f).alias(f) for f in FIELDS])


def unpacked(fields: Column) -> Column:
    return F.arrays_zip(*[fields.getField(f) for f in FIELDS]).cast(NODES)


# ---- batches -------------------------------------------------------------------------------------


def offsets_of(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)


def ints(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (0 for NULL) and whether they are there."""
    return pc.fill_null(values, 0).to_numpy(zero_copy_only=False).astype(np.int64), pc.is_valid(values).to_numpy(zero_copy_only=False)


def lists(counts: np.ndarray, values: pa.Array, there: np.ndarray | None = None) -> pa.Array:
    """An array of lists from its lengths; rows that aren't ``there`` are NULL."""
    offsets = pa.array(offsets_of(counts))
    if there is None or there.all():
        return pa.ListArray.from_arrays(offsets, values)
    return pa.ListArray.from_arrays(offsets, values, mask=pa.array(~there))


@dataclass(frozen=True)
class Batch:
    """The nodes of many paragraphs: ``row`` is a node's paragraph, ``there`` tells which paragraphs aren't NULL."""

    there: np.ndarray
    row: np.ndarray
    pos: np.ndarray
    kind: pa.Array
    text: pa.Array
    style: np.ndarray
    styled: np.ndarray
    key: pa.Array

    @classmethod
    def of(cls, nodes: pa.Array) -> Batch:
        there = pc.is_valid(nodes).to_numpy(zero_copy_only=False)
        counts = pc.fill_null(pc.list_value_length(nodes), 0).to_numpy(zero_copy_only=False)
        flat = nodes.flatten()
        style, styled = ints(flat.field("style"))
        return cls(
            there, np.repeat(np.arange(len(nodes)), counts), ints(flat.field("pos"))[0], flat.field("kind"), flat.field("text"),
            style, styled, flat.field("key"),
        )

    def is_kind(self, *kinds: str) -> np.ndarray:
        return reduce(np.logical_or, (pc.fill_null(pc.equal(self.kind, k), False).to_numpy(zero_copy_only=False) for k in kinds))

    def counts(self, some: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.row if some is None else self.row[some], minlength=len(self.there))

    def first(self) -> np.ndarray:
        """Is a node its paragraph's first?"""
        return np.diff(self.row, prepend=-1) != 0

    def within(self, amount: np.ndarray) -> np.ndarray:
        """Running sum of ``amount`` within each paragraph, a node's own included."""
        total = np.cumsum(amount)
        starts = offsets_of(self.counts())[:-1]
        before = np.concatenate([[0], total])[starts]
        return total - before[self.row]

    def take(self, places: np.ndarray) -> Batch:
        at = pa.array(places)
        return Batch(
            self.there, self.row[places], self.pos[places], self.kind.take(at), self.text.take(at), self.style[places], self.styled[places], self.key.take(at)
        )

    def styles(self) -> pa.Array:
        return pa.array(self.style.astype(np.int32), mask=~self.styled)

    def nodes(self) -> pa.Array:
        fields = [pa.array(self.pos.astype(np.int32)), self.kind, self.text, self.styles(), self.key]
        return lists(self.counts(), pa.StructArray.from_arrays(fields, list(FIELDS)), self.there)


def _blank(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.equal(pc.utf8_trim(texts, characters=C.WS_CHARS), ""), False).to_numpy(zero_copy_only=False)


def _shifted(values: np.ndarray, same_row: np.ndarray) -> np.ndarray:
    """Whether the node before has ``values``, in the same paragraph."""
    return np.concatenate([[False], values[:-1]]) & same_row if len(values) else values


def _normalized(b: Batch) -> Batch:
    is_text = b.is_kind("text")
    empty = is_text & pc.fill_null(pc.equal(b.text, ""), False).to_numpy(zero_copy_only=False)
    if empty.any():
        b, is_text = b.take(np.flatnonzero(~empty)), is_text[~empty]
    size = len(b.row)
    if not size:
        return b
    inner = ~b.first()
    after = _shifted(is_text, inner)
    following = np.minimum(np.arange(size) + 1, size - 1)
    before = is_text[following] & (b.row[following] == b.row) & (following > np.arange(size))
    # Within a stretch of text the style carries over whitespace; at its start it looks ahead.
    blank = is_text & _blank(b.text)
    source = np.where(blank & ~after & before, following, np.arange(size))
    carries = blank & after
    source = source[np.maximum.accumulate(np.where(carries, 0, np.arange(size)))]
    b = replace(b, style=b.style[source], styled=b.styled[source])
    previous = np.maximum(np.arange(size) - 1, 0)
    joins = is_text & after & b.styled & b.styled[previous] & (b.style == b.style[previous])
    if not joins.any():
        return b
    heads = np.flatnonzero(~joins)
    sizes = np.diff(np.append(heads, size))
    texts = b.text.take(pa.array(heads))
    # Only what merges is joined; a lone node keeps its text as it is.
    grown = sizes > 1
    parts = lists(sizes[grown], b.text.filter(pa.array(np.repeat(grown, sizes))))
    merged = pc.replace_with_mask(texts, pa.array(grown), pc.binary_join(parts, ""))
    return replace(b.take(heads), text=merged)


def _base(b: Batch) -> np.ndarray:
    """The style with most stripped characters for each paragraph."""
    base = np.zeros(len(b.there), dtype=np.int64)
    some = np.flatnonzero(b.is_kind("text"))
    if not len(some):
        return base
    size = pc.utf8_length(pc.utf8_trim(b.text.take(pa.array(some)), characters=C.WS_CHARS))
    size, known = ints(size)
    row, style, styled, pos = b.row[some], b.style[some], b.styled[some], b.pos[some]
    order = np.lexsort((style, styled, row))
    row, style, styled, pos, size, known = (x[order] for x in (row, style, styled, pos, size, known))
    heads = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(style, prepend=style[0]) != 0) | (np.diff(styled, prepend=styled[0]) != 0))
    total = np.where(np.logical_and.reduceat(known, heads), np.add.reduceat(size, heads), -1)
    first = np.minimum.reduceat(pos, heads)
    row, style, styled = row[heads], style[heads], styled[heads]
    order = np.lexsort((style, styled, -first, total, row))
    last = order[np.append(np.diff(row[order]) != 0, True)]
    base[row[last]] = np.where(styled[last], style[last], 0)
    return base


def _innermost(opens: np.ndarray, row: np.ndarray, gid: np.ndarray, wrapper: np.ndarray) -> np.ndarray:
    """For each of the places ``wrapper`` of open and close nodes: the group that a close node ends, or -1."""
    told = np.full(len(wrapper), -1, dtype=np.int64)
    stack: list[int] = []
    last = -1
    for k, (is_open, at, group) in enumerate(zip(opens[wrapper].tolist(), row[wrapper].tolist(), gid[wrapper].tolist(), strict=True)):
        if at != last:
            stack, last = [], at
        if is_open:
            stack.append(group)
        elif stack:
            told[k] = stack.pop()
    return told


ENCODED = f"struct<unit_text:string,base_style:int,groups:{G.GROUPS},objects:{G.OBJECTS}>"


def _encoded(b: Batch) -> pa.Array:
    base = _base(b)
    is_text, opens, closes, things = b.is_kind("text"), b.is_kind("open"), b.is_kind("close"), b.is_kind("keep", "obj")
    styled = is_text & b.styled & (b.style != base[b.row])
    grouped = styled | opens
    gid, xid = b.within(grouped), b.within(things)
    size = len(b.row)
    most = int(max(gid.max(initial=0), xid.max(initial=0)))
    # What stands in front of a node's text and behind it, as numbers of tags: none, openings, closings, things.
    front, back = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    front[grouped] = 1 + gid[grouped]
    back[styled] = 2 + most + gid[styled]
    front[things] = 3 + 2 * most + xid[things]
    wrapper = np.flatnonzero(opens | closes)
    ends = _innermost(opens, b.row, gid, wrapper)
    front[wrapper[ends >= 0]] = 2 + most + ends[ends >= 0]
    tags = pa.array(
        ["", *(f"<g{n}>" for n in range(most + 1)), *(f"</g{n}>" for n in range(most + 1)), *(f"<x{n}/>" for n in range(most + 1))], pa.string()
    )
    inside = pc.if_else(pa.array(is_text), b.text, pa.scalar("", b.text.type))
    pieces = pc.fill_null(pc.binary_join_element_wise(tags.take(pa.array(front)), inside, tags.take(pa.array(back)), ""), "")
    units = pc.binary_join(lists(b.counts(), pieces), "")
    groups = pa.StructArray.from_arrays(
        [
            pa.array(gid[grouped].astype(np.int32)), pa.array(b.style[grouped].astype(np.int32), mask=~styled[grouped]),
            pc.if_else(pa.array(opens[grouped]), b.key.filter(pa.array(grouped)), pa.scalar(None, b.key.type)),
        ],
        ["gid", "style", "wrap"],
    )
    kept = pa.array(things)
    objects = pa.StructArray.from_arrays(
        [pa.array(xid[things].astype(np.int32)), b.kind.filter(kept), b.text.filter(kept), b.styles().filter(kept), b.key.filter(kept)],
        ["xid", *FIELDS[1:]],
    )
    return pa.StructArray.from_arrays(
        [units, pa.array(base.astype(np.int32)), lists(b.counts(grouped), groups), lists(b.counts(things), objects)],
        ["unit_text", "base_style", "groups", "objects"], mask=pa.array(b.counts() == 0),
    )


def _split(b: Batch, spans: pa.Array) -> Batch:
    """``spans`` has for each node of the batch a list of start and end."""
    counts = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
    cut = np.flatnonzero((counts > 0) & b.is_kind("text"))
    starts, ends = (ints(spans.take(pa.array(cut)).flatten().field(f))[0].tolist() for f in ("start", "end"))
    texts, made, sizes, turn = b.text.take(pa.array(cut)).to_pylist(), [], np.ones(len(b.row), dtype=np.int64), 0
    for k, text in zip(cut.tolist(), texts, strict=True):
        at, before = 0, len(made)
        for _ in range(counts[k]):
            made.append((text[at : starts[turn]], False))
            made.append((text[starts[turn] : ends[turn]], True))
            at, turn = ends[turn], turn + 1
        made.append((text[at:], False))
        made[before:] = [m for m in made[before:] if m[0] != ""]
        sizes[k] = len(made) - before
    source = np.repeat(np.arange(len(b.row)), sizes)
    new = np.isin(source, cut)
    b = b.take(source)
    kind = pc.replace_with_mask(b.kind, pa.array(new), pa.array(["keep" if kept else "text" for _, kept in made], b.kind.type))
    text = pc.replace_with_mask(b.text, pa.array(new), pa.array([t for t, _ in made], b.text.type))
    return replace(b, kind=kind, text=text, pos=b.within(np.ones(len(b.row), dtype=np.int64)) - 1)


def _joined(b: Batch, translations: pa.Array, latin_target: bool) -> Batch:
    is_text, kept_text, is_obj = b.is_kind("text"), b.is_kind("keep"), b.is_kind("obj")
    base = _base(b)
    depth = b.within(b.is_kind("open").astype(np.int64) - b.is_kind("close").astype(np.int64))
    # The translation of a paragraph's n-th text node, where there is one.
    number = b.within(is_text) - 1
    given = pc.fill_null(pc.list_value_length(translations), 0).to_numpy(zero_copy_only=False)
    has = is_text & (number < given[b.row])
    at = pa.array(np.where(has, offsets_of(given)[b.row] + number, 0), mask=~has)
    said = pc.coalesce(translations.flatten().take(at), b.text)
    plain = is_text & b.styled & (b.style == base[b.row]) & (depth == 0)

    leaf = np.flatnonzero(is_text | kept_text | is_obj)
    if not len(leaf):
        return b
    texts = pc.if_else(pa.array(~is_obj[leaf]), said.take(pa.array(leaf)), pa.scalar(None, said.type))
    row, free, plain = b.row[leaf], is_text[leaf], plain[leaf]

    def told(flags: pa.Array) -> np.ndarray:
        return pc.fill_null(flags, False).to_numpy(zero_copy_only=False)

    if latin_target:
        marks = "".join("\\" + ch for ch in G.SENTENCE_PUNCTUATION)
        ends = told(pc.match_substring_regex(texts, rf"[\p{{L}}\p{{N}}{marks}]\z"))
        begins = told(pc.match_substring_regex(texts, r"\A[\p{L}\p{N}]"))
    else:
        ends = told(pc.match_substring_regex(pc.utf8_rtrim(texts, characters=C.WS_CHARS), f"[{C.JOIN_CJK}]\\z"))
        begins = told(pc.match_substring_regex(pc.utf8_ltrim(texts, characters=C.WS_CHARS), f"\\A[{C.JOIN_CJK}]"))
    # Place k stands for the boundary between leaves k - 1 and k.
    meets = np.zeros(len(leaf) + 1, dtype=bool)
    meets[1:-1] = ends[:-1] & begins[1:] & (row[:-1] == row[1:])
    right = np.zeros(len(leaf) + 1, dtype=bool)
    right[1:-1] = plain[1:] | (~free[:-1] & free[1:])
    if latin_target:
        blanks = pa.array(["", " "], texts.type)
        front, back = (blanks.take(pa.array(x.astype(np.int64))) for x in ((meets & right)[:-1], (meets & ~right)[1:]))
        new = pc.binary_join_element_wise(front, texts, back, "")
    else:
        new = pc.if_else(pa.array(meets[:-1]), pc.utf8_ltrim(texts, characters=C.WS_CHARS), texts)
        new = pc.if_else(pa.array(meets[1:]), pc.utf8_rtrim(new, characters=C.WS_CHARS), new)
    mask = np.zeros(len(b.row), dtype=bool)
    mask[leaf[free]] = True
    return replace(b, text=pc.replace_with_mask(b.text, pa.array(mask), new.filter(pa.array(free))))


# ---- expressions ---------------------------------------------------------------------------------


def normalized(nodes: Column) -> Column:
    """Empty text goes, whitespace-only text takes a neighbour's style, equal neighbours merge.

    Within a stretch of text the style carries over whitespace; at its start it looks ahead.
    """

    @F.arrow_udf(NODES)
    def normalize(nodes: pa.Array) -> pa.Array:
        return _normalized(Batch.of(nodes)).nodes()

    return normalize(nodes)


def base_style(nodes: Column) -> Column:
    """The style with most stripped characters, the earlier one on a tie; 0 without text."""

    @F.arrow_udf("int")
    def base(nodes: pa.Array) -> pa.Array:
        return pa.array(_base(Batch.of(nodes)).astype(np.int32))

    return base(nodes)


def encoded(nodes: Column) -> Column:
    """``struct<unit_text,base_style,groups,objects>`` of normalised nodes, NULL without nodes.

    The base style is plain; other styles and wrappers become ``<gN>``, kept things ``<xN/>``,
    numbered in order, so equal paragraphs give equal engine inputs.  A stack holds the wrappers that are open.
    """

    @F.arrow_udf(ENCODED)
    def encode(nodes: pa.Array) -> pa.Array:
        return _encoded(Batch.of(nodes))

    # Told to be non-deterministic, it stays a column of its own: neither its fields nor a filter repeat it.
    return encode.asNondeterministic()(nodes)


def split_spans(nodes: Column, found: Column) -> Column:
    """Nodes with each kept stretch of text as a keep node of its own.

    ``found`` has for each node an array of start and end, as ``spans_of_each`` gives it.
    """

    @F.arrow_udf(NODES)
    def split(nodes: pa.Array, found: pa.Array) -> pa.Array:
        return _split(Batch.of(nodes), found.flatten()).nodes()

    return split(nodes, found)


def texts(nodes: Column) -> Column:
    """The text of each text node, and NULL for others."""
    return F.transform(nodes, lambda n: F.when(_is_text(n), n["text"]))


def spans_of_each(nodes: Column, spans: Callable[[Column], Column]) -> Column:
    """What an expression text -> array of start and end finds in each text node."""
    return F.transform(nodes, lambda n: F.when(_is_text(n), spans(n["text"])).otherwise(F.array().cast("array<struct<start:int,end:int>>")))


def joined(nodes: Column, translations: Column, latin_target: bool) -> Column:
    """Normalised nodes rebuilt from separately translated leaves.

    ``translations`` has one entry for each text node, in order (NULL keeps the text).  Towards a Latin
    language two leaves that would run together get one space, on the plain side; towards Chinese or
    Japanese, whitespace between CJK characters goes.  Kept leaves never change.
    """

    @F.arrow_udf(NODES)
    def join(nodes: pa.Array, translations: pa.Array) -> pa.Array:
        return _normalized(_joined(Batch.of(nodes), translations, latin_target)).nodes()

    return join(nodes, translations)
