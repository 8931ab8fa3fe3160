"""Compressed sizes of texts under several zstandard raw-content dictionaries."""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DictionarySizes:
    """sizes(data): the bytes that data takes with each dictionary, block by block.

    Every block starts from the dictionary alone, so a long text counts whole and in proportion.
    """

    def __init__(self, contents: list[bytes], level: int, block: int):
        self.block = block
        params = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.shrink = []
        for content in contents:
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(compression_params=params)
            self.shrink.append(zstandard.ZstdCompressor(dict_data=shared, compression_params=params).compress)

    def sizes(self, data: bytes) -> np.ndarray:
        blocks = [data[k : k + self.block] for k in range(0, len(data), self.block)]
        return np.array([sum(len(shrink(b)) for b in blocks) for shrink in self.shrink], float)


_SIZERS: dict[int, DictionarySizes] = {}


def sizer(key: int, contents: list[bytes], level: int, block: int) -> DictionarySizes:
    """That of the model in use; a worker keeps one."""
    if key not in _SIZERS:
        _SIZERS.clear()
        _SIZERS[key] = DictionarySizes(contents, level, block)
    return _SIZERS[key]


def hashed_piece(text: Column, salt: Column, length: int) -> Column:
    """A run of at most `length` characters from a hashed place of the text, for training samples."""
    spare = F.greatest(F.char_length(text) - length, F.lit(0))
    return F.substring(text, F.pmod(F.xxhash64(salt), spare + 1).cast("int") + 1, F.lit(length))


def hashed_sample(rows: DataFrame, by: str, id_col: str, most: int, most_classes: int = 500) -> tuple[DataFrame, dict]:
    """About `most` rows of each class (all of a smaller class), chosen by a hash of the id; and the classes' counts.

    The classes are what a model predicts; more than `most_classes` are an error, found before their counts reach the driver.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(by).count().limit(most_classes + 1).collect()}
    if len(counts) > most_classes:
        raise ValueError(f"more than {most_classes} values of {by}")
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(by) == F.lit(value), F.lit(min(1.0, most / n))).otherwise(share)
    return rows.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 30)) < share * (1 << 30)), counts


def dictionary_content(pieces: list[str | bytes], most: int) -> bytes:
    """Distinct pieces up to `most` bytes, the last bytes being those nearest to the text that is compressed."""
    out, size = [], 0
    for piece in dict.fromkeys(pieces):
        data = piece.encode() if isinstance(piece, str) else piece
        out.append(data)
        size += len(data) + 1
        if size >= most:
            break
    return b"\n".join(out)[:most]
