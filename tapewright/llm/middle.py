"""Fill-in-middle: documents are cut at two lines and their parts put in another order, and back again.

The texts of a batch are one array of bytes. Cuts divide it into segments, and all
bytes of a segment move by the same distance. A difference array holds the
distance's change where a segment starts; its cumulative sum is every byte's
displacement, along which the bytes are scattered to their new places. Going back,
the same sum says for each byte of a text where in the output to gather it from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stand before the prefix, the suffix and the middle; a text that contains one of them stays plain.
MARKS = ("<P>", "<S>", "<M>")
SEED = 7
#: Percent of the documents that are rearranged, and of those that get the suffix first.
RATE, SPM_RATE = 100, 50

#: Bytes of texts that are laid out together; a longer text is laid out alone.
_SLICE = 1 << 21
#: Bytes for which displacements are held at a time.
_STEP = 1 << 20
_PLAIN, _PSM, _SPM = range(3)
_FORMS = np.array(["plain", "psm", "spm"])
_OUT = "n long, form string, prefix_chars long, middle_chars long, output string"


def draws(id_: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2**32 from the SHA-256 of ``seed:id``; a null id is written as nothing."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts (null: none) and the texts' bounds in them."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def _texts(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    offsets = pa.py_buffer(np.ascontiguousarray(bounds, np.int64))
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, offsets, pa.py_buffer(data)]).cast(pa.string())


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``_SLICE`` bytes of text, or one row."""
    _, bounds = _bytes_of(batch.column(column))
    start = 0
    while start < len(batch):
        end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + _SLICE, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def _mark_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a mark starts, in ascending order, and which one it is."""
    at = np.flatnonzero(data == ord("<"))
    at = at[at + 2 < len(data)]
    at = at[data[at + 2] == ord(">")]
    which = np.full(len(at), -1)
    for i, mark in enumerate(MARKS):
        which[data[at + 1] == ord(mark[1])] = i
    return at[which >= 0], which[which >= 0]


def _characters_before(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many code points start before each of the ascending places."""
    out, seen, done = np.zeros(len(places), np.int64), 0, 0
    for start in range(0, len(data) + 1, _STEP):
        starts = (data[start : start + _STEP] & 0xC0) != 0x80
        count = np.concatenate([[0], np.cumsum(starts)])
        until = int(np.searchsorted(places, start + len(starts), "right"))
        out[done:until] = seen + count[places[done:until] - start]
        seen, done = seen + int(count[-1]), until
    return out


def _displacements(starts: np.ndarray, shifts: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """The place of every byte after its displacement, some at a time: first byte and places.

    Segment ``i`` begins at byte ``starts[i]``, ascending, and moves by ``shifts[i]``;
    of segments with one start, all but the last are empty.
    """
    change = np.diff(shifts, prepend=0)
    carried, first = 0, 0
    for begin in range(0, size, _STEP):
        end = min(begin + _STEP, size)
        until = int(np.searchsorted(starts, end))
        moved = np.zeros(end - begin, np.int64)
        np.add.at(moved, starts[first:until] - begin, change[first:until])
        moved[0] += carried
        np.cumsum(moved, out=moved)
        carried, first = int(moved[-1]), until
        yield begin, moved + np.arange(begin, end)


def _cuts(data: np.ndarray, bounds: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each text, and where its prefix and its middle end."""
    starts, ends = bounds[:-1], bounds[1:]
    breaks = np.flatnonzero(data == ord("\n"))
    before = np.searchsorted(breaks, starts)
    full = np.searchsorted(breaks, ends) - before
    last = data[np.maximum(ends, 1) - 1] if len(data) else np.zeros(len(ends), np.uint8)
    n = full + ((ends > starts) & (last != ord("\n")))
    breaks = np.concatenate([breaks, [0]])

    def after(lines: np.ndarray) -> np.ndarray:
        inside = breaks[np.minimum(before + np.maximum(lines, 1) - 1, len(breaks) - 1)] + 1
        return np.where(lines == 0, starts, np.where(lines == n, ends, inside))

    a, b = h1 % (n + 1), h2 % (n + 1)
    return n, after(np.minimum(a, b)), after(np.maximum(a, b))


def _order(form: np.ndarray, prefix: np.ndarray, middle: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where, in bytes from an output's start, its prefix, middle and suffix begin, marks and all."""
    m = len(MARKS[0])
    spm = form == _SPM
    at_prefix = np.where(spm, 2 * m + suffix, m)
    at_suffix = np.where(spm, m, 2 * m + prefix)
    at_middle = 3 * m + prefix + suffix
    plain = form == _PLAIN
    return np.where(plain, 0, at_prefix), np.where(plain, prefix, at_middle), np.where(plain, prefix + middle, at_suffix)


def rearranged(texts: pa.Array, h: list[np.ndarray], rate: int = RATE, spm_rate: int = SPM_RATE) -> pa.RecordBatch:
    """``n, form, prefix_chars, middle_chars, output`` of a batch of texts with four numbers each."""
    data, bounds = _bytes_of(texts)
    starts, ends = bounds[:-1], bounds[1:]
    n, cut, mid = _cuts(data, bounds, h[0], h[1])
    at, _ = _mark_places(data)
    owner = np.searchsorted(bounds, at, "right") - 1
    marked = np.zeros(len(starts), bool)
    marked[owner[at + len(MARKS[0]) <= ends[owner]]] = True
    plain = marked | (starts == ends) | (h[2] % 100 >= rate)
    form = np.where(plain, _PLAIN, np.where(h[3] % 100 < spm_rate, _SPM, _PSM))

    sizes = cut - starts, mid - cut, ends - mid
    places = _order(form, *sizes)
    length = ends - starts + np.where(plain, 0, sum(map(len, MARKS)))
    new = np.concatenate([[0], np.cumsum(length)])
    out = np.empty(new[-1], np.uint8)
    segments = np.stack([starts, cut, mid], 1).ravel()
    shifts = np.stack([new[:-1] + p - s for p, s in zip(places, (starts, cut, mid), strict=True)], 1).ravel()
    for begin, to in _displacements(segments, shifts, len(data)):
        out[to] = data[begin : begin + len(to)]
    moved = np.flatnonzero(~plain)
    for mark, place in zip(MARKS, (places[0], places[2], places[1]), strict=True):
        for i, letter in enumerate(mark.encode()):
            out[new[moved] + place[moved] - len(mark) + i] = letter

    chars = _characters_before(data, segments).reshape(-1, 3)
    counts = [pa.array(chars[:, i + 1] - chars[:, i], mask=plain) for i in range(2)]
    columns = [pa.array(n), pa.array(_FORMS[form]), *counts, _texts(out, new)]
    return pa.record_batch(columns, names=["n", "form", "prefix_chars", "middle_chars", "output"])


def rebuilt(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    """The texts, from outputs and forms alone."""
    data, bounds = _bytes_of(outputs)
    names = forms.fill_null("plain").to_numpy(zero_copy_only=False)
    form = np.select([names == f for f in _FORMS[1:]], [_PSM, _SPM], _PLAIN)
    moved = np.flatnonzero(form != _PLAIN)
    at, which = _mark_places(data)
    owner = np.searchsorted(bounds, at, "right") - 1
    # A rearranged text holds no mark, and letters of a mark beside those of a text make no other one.
    mine = (form[owner] != _PLAIN) & (at + len(MARKS[0]) <= bounds[owner + 1])
    place = np.zeros((len(form), len(MARKS)), np.int64)
    place[owner[mine], which[mine]] = at[mine] - bounds[owner[mine]]
    m, length = len(MARKS[0]), np.diff(bounds)
    p, s, x = place[:, 0], place[:, 1], place[:, 2]
    spm = form == _SPM
    prefix = np.where(spm, x - p, s - p) - m
    suffix = np.where(spm, p - s, x - s) - m
    prefix, suffix = [np.where(form == _PLAIN, 0, v) for v in (prefix, suffix)]
    middle = np.where(form == _PLAIN, length, length - 3 * m - prefix - suffix)
    places = _order(form, prefix, middle, suffix)
    new = np.concatenate([[0], np.cumsum(prefix + middle + suffix)])
    assert len(moved) * 3 == mine.sum(), "an output lacks a mark, or has one too many"
    segments = np.stack([new[:-1], new[:-1] + prefix, new[:-1] + prefix + middle], 1)
    shifts = bounds[:-1, None] + np.stack(places, 1) - segments
    out = np.empty(new[-1], np.uint8)
    for begin, source in _displacements(segments.ravel(), shifts.ravel(), len(out)):
        out[begin : begin + len(source)] = data[source]
    return _texts(out, new)


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = SEED,
    rate: int = RATE,
    spm_rate: int = SPM_RATE,
) -> DataFrame:
    """For every row: ``<id_col>, n, form, prefix_chars, middle_chars, output``.

    A text's ``n`` lines, each with its line break, are divided at two of them drawn
    from the SHA-256 of ``seed:id``. ``rate`` percent of the texts are put in the
    form ``psm`` (``<P>prefix<S>suffix<M>middle``) or, ``spm_rate`` percent of
    those, ``spm`` (``<S>suffix<P>prefix<M>middle``). A null or empty text, and one that
    contains a mark, stays ``plain`` with null counts of code points.

    Rows are handled one by one: repeated rows alike, a null id as if it were
    written as nothing. Texts are whole, however long; the displacements of a part
    of a batch are held at a time. Other columns are not looked at; an empty table gives an
    empty result. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 1):
                h = [np.asarray(part.column(2 + i)) for i in range(4)]
                made = rearranged(part.column(1), h, rate, spm_rate)
                yield pa.record_batch([part.column(0), *made.columns], names=["id", *made.schema.names])

    id_ = F.col(id_col)
    rows = docs.select(id_.alias("id"), F.col(text_col).alias("text"), *[h.alias(f"h{i}") for i, h in enumerate(draws(id_, seed))])
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, {_OUT}").withColumnRenamed("id", id_col)


def restore_text(made: DataFrame, output_col: str = "output", form_col: str = "form", to: str = "text") -> DataFrame:
    """The rows of ``made`` with the text that each output was made from, as column ``to``.

    Only the output and its form are used. A null form counts as ``plain``, a null
    output as empty. All other columns are kept; a column named like ``to`` is replaced.
    """
    rest = [c for c in made.columns if c != to]
    schema = made.select([F.col(f"`{c}`") for c in rest]).schema.add(to, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            output, form = rest.index(output_col), rest.index(form_col)
            for part in _slices(batch, output):
                text = rebuilt(part.column(output), part.column(form))
                yield pa.record_batch([*part.columns, text], names=[*part.schema.names, to])

    return made.select([F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`fill_in_middle` and :func:`restore_text` of every row, with SHA-256 sums in place of the texts."""
    back = restore_text(fill_in_middle(docs, id_col, text_col), to="text")
    return back.select(
        id_col, "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"),
    )


def oracle() -> str:
    """The same in DuckDB's SQL, line by line."""
    number = "CAST('0x' || substr(digest, {}, 8) AS BIGINT) AS h{}"
    return f"""
        WITH cut AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
                   regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units
            FROM documents),
        drawn AS (SELECT *, len(units) AS n, {", ".join(number.format(8 * i + 1, i + 1) for i in range(4))} FROM cut),
        parts AS (
            SELECT *, array_to_string(units[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS prefix,
                   array_to_string(units[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS middle,
                   array_to_string(units[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS suffix,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {RATE} THEN 'plain'
                        WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form
            FROM drawn)
        SELECT doc_id, n, form,
               CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text
                               WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                               ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM parts"""
