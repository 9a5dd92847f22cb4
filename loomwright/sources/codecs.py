"""Formats by name or extension: what Spark reads itself, and arrays, Arrow files and YAML by way of binary files."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Formats and their extensions.
EXTENSIONS = {
    "parquet": ("parquet", "pq"),
    "csv": ("csv",),
    "tsv": ("tsv",),
    "json": ("json",),
    "ndjson": ("ndjson", "jsonl"),
    "orc": ("orc",),
    "text": ("txt", "log"),
    "npy": ("npy",),
    "npz": ("npz",),
    "arrow": ("arrow", "feather", "ipc"),
    "pickle": ("pickle", "pkl"),
    "yaml": ("yaml", "yml"),
}


class CodecError(ValueError):
    """A format that isn't known or can't be used."""


def detect(path: str, hint: str | None = None) -> str:
    """The format by a hint's name, by a hint's extension, or by the path's extension."""
    for word in ([hint.lower().lstrip(".")] if hint else []) + [path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()]:
        if word in EXTENSIONS:
            return word
        for name, extensions in EXTENSIONS.items():
            if word in extensions:
                return name
    raise CodecError(f"no format for {path!r}" + (f" ({hint})" if hint else ""))


def _decoded(spark: SparkSession, path: str, decode: Callable[[bytes], pd.DataFrame], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                yield decode(content)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def _arrays(content: bytes, packed: bool) -> pd.DataFrame:
    import numpy as np

    loaded = np.load(io.BytesIO(content), allow_pickle=False)
    named = [(k, loaded[k]) for k in loaded.files] if packed else [("", loaded)]
    rows = []
    for name, array in named:
        array = np.atleast_2d(np.asarray(array, "f8")) if array.ndim <= 2 else np.asarray(array, "f8").reshape(array.shape[0], -1)
        rows += [(name, i, row.tolist()) for i, row in enumerate(array)]
    return pd.DataFrame(rows, columns=["name", "row", "values"])


def _arrow_schema(spark: SparkSession, path: str) -> str:
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    first = spark.read.format("binaryFile").load(path).select("content").first()
    if first is None:
        raise CodecError(f"{path} has no files")
    return from_arrow_schema(pa.ipc.open_file(pa.BufferReader(bytes(first[0]))).schema).simpleString()[7:-1].replace(":", " ")


def _arrow(content: bytes) -> pd.DataFrame:
    import pyarrow as pa

    return pa.ipc.open_file(pa.BufferReader(bytes(content))).read_pandas()


def _yaml(content: bytes) -> pd.DataFrame:
    import json

    import yaml

    loaded = yaml.safe_load(content)
    return pd.DataFrame({"document": [json.dumps(x) for x in (loaded if isinstance(loaded, list) else [loaded])]})


def read(spark: SparkSession, path: str, hint: str | None = None, schema=None, pickles: bool = False) -> DataFrame:
    """A file or folder as a DataFrame.  Delimited files have a header and are text unless a schema is given; a JSON
    file is one document or list of them.  Arrays give (name, row, values), YAML gives JSON documents."""
    how = detect(path, hint)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if how in ("parquet", "orc", "text"):
        return reader.format(how).load(path)
    if how in ("csv", "tsv"):
        return reader.csv(path, header=True, sep="\t" if how == "tsv" else ",")
    if how in ("json", "ndjson"):
        return reader.json(path, multiLine=how == "json")
    if how in ("npy", "npz"):
        return _decoded(spark, path, lambda c, packed=how == "npz": _arrays(c, packed), "name string, row long, values array<double>")
    if how == "arrow":
        return _decoded(spark, path, _arrow, _arrow_schema(spark, path))
    if how == "yaml":
        try:
            import yaml  # noqa: F401
        except ImportError:
            raise CodecError("YAML needs the yaml module") from None
        return _decoded(spark, path, _yaml, "document string")
    if not pickles or schema is None:
        raise CodecError("a pickle can run code: allow it with pickles=True and give its schema")
    import pickle

    return _decoded(spark, path, lambda c: pd.DataFrame(pickle.loads(c)), schema)


def write(df: DataFrame, path: str, hint: str | None = None, mode: str = "overwrite") -> None:
    """A DataFrame as a folder of files in a format that Spark writes."""
    how = detect(path, hint)
    writer = df.write.mode(mode)
    if how in ("parquet", "orc"):
        writer.format(how).save(path)
    elif how in ("csv", "tsv"):
        writer.csv(path, header=True, sep="\t" if how == "tsv" else ",")
    elif how in ("json", "ndjson"):
        writer.json(path)
    elif how == "text":
        df.select(F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in df.columns]).alias("value")).write.mode(mode).text(path)
    else:
        raise CodecError(f"{how} is read only")

