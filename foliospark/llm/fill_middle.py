"""Fill-in-middle transformation by block rotation inside one byte buffer.

A text is cut after two units (a word with the white space before it; white space at the
end is a unit) into prefix, middle and suffix. The sentinels go into a bytearray at the
cuts, in text order, and then two neighbouring blocks change places by three reversals::

    <P>prefix<M>middle<S>suffix      psm: <M>middle  with <S>suffix
                                     spm: <P>prefix<M>middle  with <S>suffix

``restored`` finds the sentinels, turns the blocks back by the inverse rotation and takes
the sentinels out, which gives the text byte for byte.

The choice depends on the id alone: h1 to h4 are the first four 8-digit groups of the hex
sha256 of ``seed:id``; h1 and h2 modulo units + 1 are the cuts, h3 modulo 100 decides
whether the text is changed at all and h4 modulo 100 which form it takes.

Nulls and odd input: a null text is empty and stays plain, as does a text that holds a
sentinel; a null id counts as an empty one; repeated rows give repeated results; cuts may
coincide or lie at the ends, so blocks may be empty; an empty table gives an empty result;
other columns are not read. A text of any length is one buffer in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from foliospark.llm.common import texts

SEED = 42
#: Texts in a hundred that are changed, and of those the ones that take the form spm.
CHANGED, SUFFIX_FIRST = 50, 80
P, S, M = b"<P>", b"<S>", b"<M>"
#: What one row becomes.
MADE = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType()),
    ]
)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def ends(text: bytes) -> np.ndarray:
    """Where each unit of ``text`` ends."""
    space = _SPACE[np.frombuffer(text, np.uint8)]
    found = np.flatnonzero(~space & np.append(space[1:], True)) + 1 if len(text) else np.zeros(0, np.int64)
    return np.append(found, len(text)) if len(text) and space[-1] else found


def rotate(data: bytearray, start: int, middle: int, stop: int) -> None:
    """Exchange data[start:middle] and data[middle:stop]: both are reversed, then the whole."""
    for a, b in ((start, middle), (middle, stop), (start, stop)):
        data[a:b] = data[a:b][::-1]


def rotated(text: bytes, first: int, second: int, suffix_first: bool) -> bytearray:
    """``text`` with sentinels at its start and two cuts, in the order of the form."""
    data = bytearray(text)
    for cut, mark in ((second, S), (first, M), (0, P)):  # from the end, so that cuts stay valid
        data[cut:cut] = mark
    rotate(data, 0 if suffix_first else first + len(P), second + len(P) + len(M), len(data))
    return data


def restored_bytes(output: bytes, form: str) -> bytes:
    """The text that ``output`` was made from."""
    if form == "plain":
        return output
    data = bytearray(output)
    if form == "spm":  # <S>suffix | <P>prefix<M>middle
        rotate(data, 0, data.index(P), len(data))
    else:  # <P>prefix | <S>suffix | <M>middle
        start = data.index(S)
        rotate(data, start, data.index(M, start), len(data))
    for mark in (S, M, P):  # each stands once
        place = data.index(mark)
        del data[place : place + len(mark)]
    return bytes(data)


def _points(part: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero(np.frombuffer(part, np.uint8) & 0xC0 != 0x80))


def transformed(text: bytes, digest: str) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of prefix and middle, output) for the hex digest of a row."""
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    stops = ends(text)
    n = len(stops)
    if not text or P in text or S in text or M in text or h3 % 100 >= CHANGED:
        return n, "plain", None, None, text
    first, second = (int(stops[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    spm = h4 % 100 < SUFFIX_FIRST
    output = bytes(rotated(text, first, second, spm))
    return n, "spm" if spm else "psm", _points(text[:first]), _points(text[first:second]), output


@F.arrow_udf(MADE)
def _transform(text: pa.Array, digest: pa.Array) -> pa.Array:
    rows = [transformed(t, d) for t, d in zip(texts(text), digest.to_pylist(), strict=True)]
    n, form, prefix, middle, output = zip(*rows, strict=True) if rows else [()] * 5
    columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64())]
    return pa.StructArray.from_arrays([*columns, pa.array(output, pa.binary()).cast(pa.string())], MADE.names)


@F.arrow_udf(T.StringType())
def _restore(output: pa.Array, form: pa.Array) -> pa.Array:
    back = [restored_bytes(o, f) for o, f in zip(texts(output), form.to_pylist(), strict=True)]
    return pa.array(back, pa.binary()).cast(pa.string())


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text that a row was made from."""
    return _restore(output, form)


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """(``key``, n, form, prefix_chars, middle_chars, output), one row for each row of ``docs``."""
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    made = docs.select(F.col(key).alias("key"), _transform(F.coalesce(F.col(text), F.lit("")), draw).alias("made"))
    return made.select(F.col("key").alias(key), "made.*")
