"""16-bit WAV files as rows, their checks and levels."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RATE = 16_000
RATES = (8_000, 16_000, 22_050, 32_000, 44_100, 48_000)
SCHEMA = "path string, rate int, width int, channels int, n_frames bigint, samples array<float>"


def resample(samples: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """By linear interpolation."""
    if rate == to or not len(samples):
        return samples
    n = int(round(len(samples) * to / rate))
    return np.interp(np.arange(n) * rate / to, np.arange(len(samples)), samples).astype(np.float32)


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for path, content in zip(batch["path"], batch["content"], strict=True):
            try:
                with wave.open(io.BytesIO(bytes(content))) as f:
                    rate, width, channels, n = f.getframerate(), f.getsampwidth(), f.getnchannels(), f.getnframes()
                    raw = f.readframes(n)
                samples = np.frombuffer(raw, "<i2")[::channels].astype(np.float32) / 32768 if width == 2 else np.zeros(0, np.float32)
                out.append((path, rate, width, channels, n, resample(samples, rate).tolist()))
            except (wave.Error, EOFError):
                out.append((path, None, None, None, None, []))
        yield pd.DataFrame(out, columns=["path", "rate", "width", "channels", "n_frames", "samples"]).astype({c: "Int64" for c in ("rate", "width", "channels", "n_frames")})


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """WAV files below a path: header fields, and the first channel at 16 kHz; a file that isn't one has nulls and no samples."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path)
    return files.select("path", "content").mapInPandas(_decode, SCHEMA)


def wav_fault() -> Column:
    """Why a file can't be used, or null."""
    return (
        F.when(F.col("rate").isNull(), "unreadable")
        .when(F.col("width") != 2, "not 16-bit")
        .when(F.col("channels") < 1, "no channel")
        .when(F.col("n_frames") < 1, "no frames")
        .when(~F.col("rate").isin(*RATES), "rate not supported")
    )


def levels(samples: Column, clip: float = 0.999) -> dict[str, Column]:
    """Peak, share of clipped samples and their number."""
    peak = F.coalesce(F.array_max(F.transform(samples, F.abs)), F.lit(0.0).cast("float"))
    clipped = F.size(F.filter(samples, lambda x: F.abs(x) >= clip))
    return {"peak": peak, "n_clipped": clipped, "clip_percent": F.when(F.size(samples) > 0, 100.0 * clipped / F.size(samples)).otherwise(F.lit(0.0))}
