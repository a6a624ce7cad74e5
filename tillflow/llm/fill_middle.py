"""Fill-in-middle transformation as a pyarrow.compute pipeline.

A text is cut into a prefix, a middle and a suffix at two of its n + 1 places between code points and put together
anew with a mark before each piece: prefix, suffix, middle (psm) or suffix, prefix, middle (spm). Places, form and
order follow from a hash of the id, so that every run and every machine gives the same.

A batch is handled as a whole. Its texts become list arrays of code points; the lists are flattened with the indices
of their parents, ordinals within the parent are computed, code points are filtered by their role, each role's code
points are counted per parent and become lists again, and `binary_join` makes the pieces, which are joined with their
marks element by element. Batches are cut into groups of whole texts of about GROUP_CHARS characters, so a task holds a
fixed number of code points, or one text.

The form is plain (the text itself) for empty texts, for texts that hold a mark, and for a share of the others. In other
texts no mark can arise at a seam, since a mark begins and ends with characters it holds once; so the text is rebuilt
from output and form alone by splitting at the marks.

Defined cases: NULL counts as the empty text; a NULL id is hashed as an empty one; very long texts are cut as a
whole; repeated rows give the same result; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Of 100 texts so many keep their order, and of 100 others so many have the suffix first.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
#: Characters of text handled at a time.
GROUP_CHARS = 400_000

RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(id_col: Column, seed: str = "1") -> list[Column]:
    """Four unsigned 32-bit numbers from the hash of an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def code_points(texts: pa.Array) -> pa.ListArray:
    """Texts as lists of their code points; the text data is shared, only borders are computed."""
    texts = texts.cast(pa.large_string())
    borders = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1, offset=8 * texts.offset)
    size = int(borders[-1]) if len(texts) else 0
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8, count=size)
    at = np.append(np.flatnonzero(data & 0xC0 != 0x80), size)
    points = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), texts.buffers()[2] or pa.py_buffer(b""))
    return pa.LargeListArray.from_arrays(pa.array(np.searchsorted(at, borders)), points)


def lists_of(points: pa.Array, parents: pa.Array, rows: int) -> pa.Array:
    """Lists of the points of each of so many parents, then their joined texts."""
    counts = np.bincount(parents.to_numpy(zero_copy_only=False), minlength=rows)
    borders = pa.array(np.concatenate(([0], np.cumsum(counts))))
    return pc.binary_join(pa.LargeListArray.from_arrays(borders, points), pa.scalar("", pa.large_string()))


def pieces(texts: pa.Array, first: pa.Array, second: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Prefix, middle and suffix of each text, cut at its first and second place."""
    lists = code_points(texts)
    points, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    begins = pc.subtract(lists.offsets.slice(0, len(lists)), lists.offsets[0])
    ordinals = pc.subtract(pa.array(np.arange(len(points))), pc.take(begins, parents))
    early = pc.less(ordinals, pc.take(first, parents))
    late = pc.greater_equal(ordinals, pc.take(second, parents))
    roles = (early, pc.invert(pc.or_(early, late)), late)
    return tuple(lists_of(pc.filter(points, role), pc.filter(parents, role), len(texts)) for role in roles)


def transform_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Columns doc_id, text, h1, h2, h3, h4 to those of RESULT."""
    texts = pc.fill_null(batch.column("text"), "").cast(pa.large_string())
    n = pc.cast(pc.utf8_length(texts), pa.int64())
    spots = pc.add(n, 1)
    h = [batch.column(f"h{i}") for i in (1, 2, 3, 4)]
    cut = [pc.subtract(x, pc.multiply(pc.divide(x, spots), spots)) for x in h[:2]]
    share = [pc.subtract(x, pc.multiply(pc.divide(x, 100), 100)) for x in h[2:]]
    first, second = pc.min_element_wise(*cut), pc.max_element_wise(*cut)
    plain = pc.or_(pc.equal(n, 0), pc.greater_equal(share[0], 100 - PLAIN_PERCENT))
    for mark in MARKS:
        plain = pc.or_(plain, pc.match_substring(texts, mark))
    form = pc.if_else(plain, PLAIN, pc.if_else(pc.less(share[1], SPM_PERCENT), SPM, PSM))
    prefix, middle, suffix = pieces(texts, first, second)
    none = pa.scalar("", pa.large_string())
    put = lambda *parts: pc.binary_join_element_wise(*[pa.scalar(p, pa.large_string()) if isinstance(p, str) else p for p in parts], none)
    psm, spm = put(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle), put(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    output = pc.if_else(plain, texts, pc.if_else(pc.equal(form, SPM), spm, psm))
    nothing = pa.scalar(None, pa.int64())
    columns = [batch.column("doc_id"), n, form, pc.if_else(plain, nothing, first), pc.if_else(plain, nothing, pc.subtract(second, first))]
    return pa.RecordBatch.from_arrays([*columns, _short(output)], [c.split()[0] for c in RESULT.split(", ")])


def restore_batch(output: pa.Array, form: pa.Array) -> pa.Array:
    """The text of each output and form."""
    output = output.cast(pa.large_string())
    parts = []
    for mark, other in ((PREFIX, SUFFIX), (SUFFIX, PREFIX)):
        begin, middle = _halves(output, MIDDLE)
        one, two = _halves(pc.utf8_slice_codeunits(begin, len(mark)), other)
        parts.append((one, two, middle))
    none = pa.scalar("", pa.large_string())
    (p, s, m), (t, q, k) = parts
    psm, spm = pc.binary_join_element_wise(p, m, s, none), pc.binary_join_element_wise(q, k, t, none)
    return _short(pc.if_else(pc.equal(form, PLAIN), output, pc.if_else(pc.equal(form, SPM), spm, psm)))


def _halves(texts: pa.Array, mark: str) -> tuple[pa.Array, pa.Array]:
    """What stands before and after the first mark; all and nothing without one."""
    split = pc.split_pattern(texts, mark, max_splits=1)
    first = pc.list_element(split, 0)
    ends = split.offsets
    several = pc.greater(pc.list_value_length(split), 1)
    after = pc.take(split.values, pc.if_else(several, pc.subtract(ends.slice(1), 1), 0))
    return first, pc.if_else(several, after, pa.scalar("", after.type))


def _short(texts: pa.Array) -> pa.Array:
    return pc.cast(texts, pa.string())


def _groups(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows of about GROUP_CHARS bytes of text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(sizes):
        before = int(sizes[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, before + GROUP_CHARS, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from map(transform_batch, _groups(batch, "text"))


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _groups(batch, "output"):
            text = restore_batch(part.column("output"), part.column("form"))
            yield pa.RecordBatch.from_arrays([*part.columns, text], [*part.schema.names, "restored"])


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1") -> DataFrame:
    """One row per row of docs: doc_id, n, form, prefix_chars, middle_chars, output."""
    named = F.col(id_col).cast("long")
    hashed = {f"h{i + 1}": h for i, h in enumerate(draws(named, seed))}
    return docs.select(named.alias("doc_id"), F.col(text_col).alias("text"), *[c.alias(k) for k, c in hashed.items()]).mapInArrow(_transform, RESULT)


def restore(transformed: DataFrame) -> DataFrame:
    """Rows of `transform` with the text rebuilt from output and form."""
    return transformed.select(*[c.split()[0] for c in RESULT.split(", ")]).mapInArrow(_restore, f"{RESULT}, restored string")
