"""Sinks. Tables go to Parquet or JSON lines; pretty documents are for small results only."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import safe_name

MOST_ROWS = 100_000


def to_document(meta: dict, rows: DataFrame, key: str = "pairs", most: int = MOST_ROWS) -> str:
    """{meta, rows} as indented JSON, for at most ``most`` rows; more belong in ``write_lines``."""
    taken = rows.limit(most + 1).toJSON().collect()
    if len(taken) > most:
        raise ValueError(f"more than {most} rows; write them as lines")
    return json.dumps({"meta": meta, key: [json.loads(x) for x in taken]}, ensure_ascii=False, indent=2)


def write_lines(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Gzip JSON lines, written by all tasks."""
    rows.write.mode(mode).option("compression", "gzip").json(path)


def write_unit(rows: DataFrame, path: str, by: list[str]) -> None:
    """Replace only the folders of the units in ``rows``; running a unit again doesn't double it."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_lines(rows: DataFrame, path: str) -> None:
    """Append results as JSON lines."""
    rows.write.mode("append").json(path)


def image_names(renders: DataFrame, prefix: str = "src") -> DataFrame:
    """The file name of each render, from its code points and font."""
    from ..functions.codepoints import hex_name

    return renders.withColumn("png", F.concat(F.lit(f"{prefix}_"), hex_name(F.col("ch")), F.lit("_"), safe_name(F.col("font")), F.lit(".png")))


def encode_images(renders: DataFrame) -> DataFrame:
    """Name and PNG bytes of grey renders (png, pixels, width, height), ready for any store."""
    import pandas as pd

    from ..functions.pixels import encode_png

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"png": b.png, "content": [encode_png(bytes(p), int(w), int(h)) for p, w, h in zip(b.pixels, b.width, b.height, strict=True)]})

    return renders.select("png", "pixels", "width", "height").mapInPandas(work, "png string, content binary")


def write_images(renders: DataFrame, path: str) -> int:
    """A PNG file under ``path`` for each render; how many were written.

    A file's name tells what it holds, so a task that runs again writes the same file. Where Python can't open
    the store, keep what ``encode_images`` gives as a table.
    """
    import pandas as pd
    import pyarrow.fs as pafs

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, place = (pafs.LocalFileSystem(), path[len("file://") :]) if path.startswith("file://") else pafs.FileSystem.from_uri(path)
        store.create_dir(place, recursive=True)
        for b in batches:
            for name, content in zip(b.png, b.content, strict=True):
                with store.open_output_stream(f"{place}/{name}") as file:
                    file.write(bytes(content))
            yield pd.DataFrame({"n": [len(b)]})

    return encode_images(renders).mapInPandas(work, "n long").agg({"n": "sum"}).first()[0] or 0


#: Fixed value: pixels left free above the cells of a strip.
LABEL = 16


def strips(cells: DataFrame, side: int = 48) -> DataFrame:
    """Renders side by side as one grey render each (png, pixels, width, height), for ``encode_images``.

    ``cells`` has png (the strip's name), place (0, 1, ...), and pixels of ``side`` x ``side``, null for a cell that
    stays white; a strip is as long as the greatest place that any strip of its name has, and has at most some cells.
    """
    import numpy as np
    import pandas as pd

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b["cells"]:
                image = np.full((side + LABEL, side * len(row)), 255, np.uint8)
                for k, pixels in enumerate(row):
                    if pixels is not None:
                        image[LABEL:, k * side : (k + 1) * side] = np.frombuffer(pixels, np.uint8).reshape(side, side)
                out.append((image.tobytes(), image.shape[1], image.shape[0]))
            yield pd.DataFrame({"png": b.png, "pixels": [x[0] for x in out], "width": [x[1] for x in out], "height": [x[2] for x in out]})

    placed = cells.groupBy("png").agg(F.map_from_entries(F.collect_list(F.struct("place", "pixels"))).alias("by"), F.max("place").alias("last"))
    rows = placed.select("png", F.transform(F.sequence(F.lit(0), "last"), lambda k: F.col("by")[k]).alias("cells"))
    return rows.mapInPandas(compose, "png string, pixels binary, width int, height int")


def triptychs(vectors: DataFrame, renders: DataFrame) -> DataFrame:
    """A strip for each vector (char, tr39, nfkc) and font: the character and its two readings.

    ``renders`` has ch, font and 48 x 48 pixels.
    """
    from ..functions.codepoints import hex_name

    cells = vectors.select("char", F.posexplode(F.array("char", "tr39", "nfkc")).alias("place", "ch"))
    fonts = vectors.select("char").join(renders.select(F.col("ch").alias("char"), "font"), "char").distinct()
    wanted = cells.join(fonts, "char")
    drawn = wanted.join(renders.select("ch", "font", "pixels"), ["ch", "font"], "left")
    return strips(drawn.select(F.concat(F.lit("U"), hex_name(F.col("char")), F.lit("_"), safe_name(F.col("font")), F.lit(".png")).alias("png"), "place", "pixels"))


def table_lines(rows: DataFrame, widths: dict[str, int], most: int = 50) -> list[str]:
    """Fixed-width lines of the first rows."""
    from ..functions.labels import pad_right

    cells = [pad_right(F.coalesce(F.col(c).cast("string"), F.lit("")), w) for c, w in widths.items()]
    return [" ".join(n.ljust(w) for n, w in widths.items()), *(r[0] for r in rows.limit(most).select(F.concat_ws(" ", *cells)).collect())]
