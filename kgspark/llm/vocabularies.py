"""Vocabulary files of public tokenizers, as the driver reads and sends them."""

from __future__ import annotations

import os

from pyspark import Broadcast
from pyspark.sql import SparkSession

#: A vocabulary is sent to every executor, so a larger file is refused.
MAX_BYTES = 64 << 20


def sent(spark: SparkSession, path: str) -> Broadcast:
    """The file's bytes for all executors, which need not have the file."""
    if os.path.getsize(path) > MAX_BYTES:
        raise ValueError(f"{path} is larger than {MAX_BYTES} bytes")
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
