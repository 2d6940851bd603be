"""What the corpus operators share: reading tables, batches, joins with hot keys, and memoised tokenising."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, shared_dir, temporary, written  # noqa: F401 - the corpus operators' names for shared storage

#: Rows and bytes of an Arrow batch. Whole texts travel in batches, so a batch's bytes are bounded too.
BATCH_ROWS, BATCH_BYTES = 8192, 4 << 20
#: Keys that have more than one in so many of a table's rows are few enough to be sent to every task.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; the path is only ever given to Spark's readers."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch can hold in a Python worker: many small rows, or a few whole texts or blocks."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def join_names(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """rows joined with names, one row a key, where a key may have a large share of the rows.

    Keys with more than one in HOT of the rows are fewer than HOT: their names go to every task, their rows stay.
    """
    n = rows.count()
    hot = rows.groupBy(key).agg(F.count("*").alias("_rows")).where(F.col("_rows") * HOT > n).select(key)
    hot = written(names.join(F.broadcast(hot), key, "left_semi"), "hot")
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(names, key))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# Characters whose class and case the patterns below know for certain: ASCII and Latin-1 without
# the odd spaces. A text with any other character is encoded whole by the library.
_KNOWN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]*")
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The pre-tokenisers' patterns (fixed values of the two vocabularies) over those characters.
_BYTE_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
_WORD_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")


def _alphabet() -> dict[int, int]:
    """The character that byte-level vocabularies have for each byte: printable ones themselves, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: b if b in plain else next(rest) for b in range(256)}


class IdEncoder:
    """Texts to little-endian uint32 ids, as the tokenizers library gives them.

    Both vocabularies split a text into pieces and merge inside a piece only, so a piece's ids can
    be remembered: a worker keeps up to max_pieces of them and starts anew when that many are held.
    Texts with a character outside ASCII and Latin-1 go through the library whole.
    """

    def __init__(self, path: str, max_pieces: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        self.model, self.alphabet = self.lib.model, _alphabet()
        with open(path, encoding="utf-8") as f:
            normalizer = json.load(f).get("normalizer")
        self.lower = "Lowercase" in str(normalizer)
        if self.lower:
            self.pieces = _WORD_PIECES.findall
        else:
            self.pieces = _BYTE_PIECES.findall
        self.max_pieces = max_pieces
        self.held: dict[str, bytes] = {}

    def _learn(self, want: set[str]) -> None:
        import array

        missing = [p for p in want if p not in self.held]
        if len(self.held) + len(missing) > self.max_pieces:
            self.held.clear()
            missing = want  # those held until now are needed as well
        # What the library does to a piece, without what it does to a text.
        for piece in missing:
            tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.alphabet))
            self.held[piece] = array.array("I", [t.id for t in tokens]).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """A null text has no ids, like an empty one."""
        import array

        split, want = [], set()
        for text in texts:
            text = text or ""
            if _KNOWN.fullmatch(text):
                pieces = self.pieces(text.lower() if self.lower else text)
                want.update(pieces)
                split.append(pieces)
            else:
                split.append(text)
        self._learn(want)
        out = []
        for x in split:
            if isinstance(x, str):
                out.append(array.array("I", self.lib.encode(x, add_special_tokens=False).ids).tobytes())
            else:
                out.append(b"".join(map(self.held.__getitem__, x)))
        return out


_ENCODERS: dict[str, IdEncoder] = {}


def encoder(path: str) -> IdEncoder:
    """The worker process's encoder, which lasts over its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = IdEncoder(path)
    return _ENCODERS[path]
