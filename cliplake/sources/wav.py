"""Wave files: 16 or 32 bit PCM to samples in [-1, 1), the first channel of several."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_samples(data: bytes) -> tuple[np.ndarray, int]:
    with wave.open(io.BytesIO(data)) as w:
        width, channels, rate, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    if width not in (2, 4):
        raise ValueError(f"unsupported sample width: {width}")
    kind, scale = ("<i2", 32768.0) if width == 2 else ("<i4", 2147483648.0)
    return np.frombuffer(raw, kind)[::channels].astype(np.float64) / scale, rate


def decode_wavs(spark: SparkSession, folder: str) -> DataFrame:
    """path, rate, n_samples, samples, error of every wave file in the folder; a broken file has an error and no samples."""
    schema = T.StructType([T.StructField("rate", T.IntegerType()), T.StructField("n_samples", T.LongType()), T.StructField("samples", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])

    @F.pandas_udf(schema)
    def decode(content: pd.Series) -> pd.DataFrame:
        out = []
        for c in content:
            try:
                x, rate = read_samples(bytes(c))
                out.append((rate, len(x), x.astype(np.float32), None))
            except Exception as e:  # noqa: BLE001 - one broken file must not end the scan
                out.append((None, None, None, str(e)))
        return pd.DataFrame(out, columns=["rate", "n_samples", "samples", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder)
    return files.select("path", decode("content").alias("d")).select("path", "d.*")


def sample_bytes(value: int = 16384, n: int = 100, rate: int = 16000) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.full(n, value, "<i2").tobytes())
    return out.getvalue()


def write_sample(spark: SparkSession, folder: str) -> None:
    """One generated wave file in the (shared) folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder + "/tone.wav")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    out.write(bytearray(sample_bytes()))
    out.close()
