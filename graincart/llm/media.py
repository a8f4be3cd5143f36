"""Media columns: progressive JPEG files in and out of DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graincart.llm.common import beside, in_pandas
from graincart.llm.jpeg import decode, pack, to_rgb, unpack

UNIT = 192
#: Bytes that a Python task holds before it hands rows on.
HELD = 8_000_000


def payload_of(text: str | None) -> bytes:
    """UTF-8 of ``text``, filled with spaces to a positive multiple of ``UNIT`` bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % UNIT if raw else UNIT)


def decode_images(df: DataFrame, column: str = "media", carry: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``carry`` with height, width and rgb (binary: height x width x 3 samples) of JPEG files.

    A null file, or one that is no progressive JPEG, gives nulls. Repeated rows stay; an empty
    table gives an empty result.
    """

    def work(files: list[bytes | None]) -> list:
        rows = []
        for data in files:
            try:
                rgb = to_rgb(decode(bytes(data)))
                rows.append((rgb.shape[0], rgb.shape[1], rgb.tobytes()))
            except (TypeError, ValueError, IndexError, KeyError, AttributeError):
                rows.append((None, None, None))
        return list(zip(*rows, strict=True)) or [(), (), ()]

    return beside(df, (column,), carry, work, {"height": "int", "width": "int", "rgb": "binary"})


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, payload, height, width and rgb: each text of ``docs`` stored as a progressive JPEG file.

    payload is what comes back from the stored bytes, and rgb the tensor of height x width x 3 samples
    that they decode to, row by row. A null text counts as empty; its payload is 192 spaces. Equal
    texts, so repeated rows too, have equal results. Texts of any length are stored whole. An empty
    table gives an empty result. Only doc_id and text are read.
    """
    names = ["doc_id", "n_bytes", "media", "payload", "height", "width", "rgb"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                stored = pack(payload_of(text))
                image = decode(stored)
                rgb = to_rgb(image)
                size = len(text.encode("utf-8", "surrogatepass")) if text else 0
                rows.append((doc_id, size, stored, unpack(image), rgb.shape[0], rgb.shape[1], rgb.tobytes()))
                held += len(stored) + rgb.nbytes
                if held > HELD:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    return in_pandas(docs.select("doc_id", "text"), run, "doc_id", "n_bytes long, media binary, payload binary, height int, width int, rgb binary")


def media_digests(docs: DataFrame) -> DataFrame:
    """Digests of what ``store_media`` gives for each row of ``docs``; the feature is the size of the image and a sum of its samples."""
    out = store_media(docs)
    feature = F.concat_ws(":", F.concat_ws("x", "width", "height"), F.lower(F.hex(F.crc32("rgb"))))
    return out.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )
