"""Signals in packed form: a row for each signal, its samples in one array.

The operators of ``signal`` and ``timeline`` for whole signals: (keys, sr, samples
array<float or double>), instead of a row for each sample. Samples never leave their
row; what is shuffled are whole signals, and only where an operator joins them.
The kernels are Arrow functions that look at a signal in blocks of BLOCK samples, so
beside the signal itself little is held. A null sample counts as NaN.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cadenza.operators.signal import ANCHOR_S, FADE_MS, KEEP_END_MS, KEEP_START_MS, PEAK, RADIUS_S, THRESHOLD, WINDOW_MS, samples_in
from cadenza.sources.shared import written

BLOCK = 1 << 18


def signals_of(column: pa.ListArray) -> list[np.ndarray | None]:
    """The samples of each row, None for null."""
    flat = column.values
    flat = (flat.cast(pa.float64()).fill_null(np.nan) if flat.null_count else flat).to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    return [flat[a:b] if ok else None for a, b, ok in zip(offsets[:-1], offsets[1:], column.is_valid().to_numpy(zero_copy_only=False))]


def _lists(rows: list[np.ndarray | None]) -> pa.ListArray:
    sizes = [0 if r is None else len(r) for r in rows]
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.array([r is None for r in rows] + [False]))
    flat = np.concatenate([r for r in rows if r is not None] or [np.zeros(0)])
    return pa.ListArray.from_arrays(offsets, pa.array(flat, pa.float64()))


def _arrays(kernel: Callable[..., np.ndarray], *columns: Column) -> Column:
    """array<double> that a kernel makes of a signal and figures of its row."""

    @F.arrow_udf("array<double>")
    def run(samples: pa.Array, *others: pa.Array) -> pa.Array:
        more = [c.to_pylist() for c in others]
        return _lists([None if x is None else kernel(x, *own) for x, *own in zip(signals_of(samples), *more)])

    return run(*columns)


def _figures(kernel: Callable[..., tuple | None], fields: dict[str, str], *columns: Column) -> Column:
    """A struct of figures that a kernel finds in a signal; null where it finds none."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}

    @F.arrow_udf("struct<" + ", ".join(f"{k}: {v}" for k, v in fields.items()) + ">")
    def run(samples: pa.Array, *others: pa.Array) -> pa.Array:
        more = [c.to_pylist() for c in others]
        rows = [None if x is None else kernel(x, *own) for x, *own in zip(signals_of(samples), *more)]
        return pa.array([None if r is None else dict(zip(fields, r)) for r in rows], pa.struct([(k, kinds[v]) for k, v in fields.items()]))

    return run(*columns)


def rms(x: np.ndarray, width: int) -> np.ndarray:
    """Of windows that don't overlap; a short last one counts."""
    whole, out = len(x) // width, np.empty(-(-len(x) // width))
    step = max(1, BLOCK // width)
    for a in range(0, whole, step):
        b = min(whole, a + step)
        part = x[a * width : b * width].astype(np.float64).reshape(-1, width)
        out[a:b] = np.sqrt(np.mean(part * part, axis=1))
    if whole < len(out):
        out[-1] = np.sqrt(np.mean(x[whole * width :].astype(np.float64) ** 2))
    return out


def _activity(x: np.ndarray, width: int, threshold: float) -> tuple[int, int] | None:
    loud = np.flatnonzero(rms(x, width) > threshold)
    return (int(loud[0]) * width, min((int(loud[-1]) + 1) * width, len(x))) if len(loud) else None


def rms_windows(signals: DataFrame, sr: int, window_ms: float = WINDOW_MS) -> DataFrame:
    """id, n, w, start, size, rms: a row for each window."""
    width = max(1, samples_in(sr, window_ms))
    rows = signals.select("id", F.size("samples").alias("n"), F.posexplode(_arrays(lambda x: rms(x, width), F.col("samples"))).alias("w", "rms"))
    start = F.col("w") * width
    return rows.select("id", "n", F.col("w").cast("long").alias("w"), start.cast("long").alias("start"), F.least(F.lit(width), F.col("n") - start).cast("long").alias("size"), "rms")


def activity(signals: DataFrame, sr: int, threshold: float = THRESHOLD, window_ms: float = WINDOW_MS) -> DataFrame:
    """``signals`` with start and end of what is louder than the threshold; null in silent signals."""
    width = max(1, samples_in(sr, window_ms))
    found = _figures(lambda x: _activity(x, width, threshold), {"start": "int", "end": "int"}, F.col("samples"))
    return signals.withColumn("_a", found).withColumns({"start": F.col("_a.start"), "end": F.col("_a.end")}).drop("_a")


def detect_activity(signals: DataFrame, sr: int, threshold: float = THRESHOLD, window_ms: float = WINDOW_MS) -> DataFrame:
    """id, n, start, end; silent signals are left out."""
    return activity(signals, sr, threshold, window_ms).filter("start IS NOT NULL").select("id", F.size("samples").alias("n"), "start", "end")


def trim_silence(signals: DataFrame, sr: int, keep_start_ms: float = KEEP_START_MS, keep_end_ms: float = KEEP_END_MS, threshold: float = THRESHOLD, window_ms: float = WINDOW_MS) -> DataFrame:
    """``signals`` cropped to their activity and margins, with the activity's new start and end; silent ones are left out."""
    low = F.greatest(F.lit(0), F.col("start") - samples_in(sr, keep_start_ms))
    high = F.least(F.size("samples"), F.col("end") + samples_in(sr, keep_end_ms))
    rows = activity(signals, sr, threshold, window_ms).filter("start IS NOT NULL").withColumns({"_low": low, "_high": high})
    return rows.withColumns({"samples": F.slice("samples", F.col("_low") + 1, F.col("_high") - F.col("_low")), "start": F.col("start") - F.col("_low"), "end": F.col("end") - F.col("_low")}).drop("_low", "_high")


def faded(x: np.ndarray, fade: int) -> np.ndarray:
    """Linear ramp up over the first and down over the last min(fade, n div 4) samples."""
    out, m = x.astype(np.float64), min(fade, len(x) // 4)
    if m:
        ramp = np.arange(m) / max(m - 1, 1)
        out[:m] *= ramp
        out[len(out) - m :] *= ramp[::-1] if m > 1 else 1.0
    return out


def edge_fade(signals: DataFrame, sr: int, fade_ms: float = FADE_MS) -> DataFrame:
    fade = samples_in(sr, fade_ms)
    return signals.withColumn("samples", _arrays(lambda x: faded(x, fade), F.col("samples")))


def render_chunks(signals: DataFrame, sr: int) -> DataFrame:
    """Trimmed and faded."""
    return edge_fade(trim_silence(signals, sr), sr)


def _peak(x: np.ndarray) -> tuple[float] | None:
    peaks = [float(np.abs(x[a : a + BLOCK]).max()) for a in range(0, len(x), BLOCK)]
    return (float(np.max(peaks)),) if peaks else None


def normalize_peak(signals: DataFrame, doc_col: str = "doc_id", target: float = PEAK) -> DataFrame:
    """One gain for each document, as its largest amplitude over all its signals wants it; documents without a usable one are left out."""
    peaks = signals.groupBy(doc_col).agg(F.max(_figures(_peak, {"peak": "double"}, F.col("samples"))["peak"]).alias("_peak"))
    usable = written(peaks.filter((F.col("_peak") > 0) & (F.col("_peak") < float("inf"))), "peaks")
    rows = signals.join(usable, doc_col).withColumn("gain", F.lit(target) / F.col("_peak"))
    return rows.withColumn("samples", _arrays(lambda x, gain: x.astype(np.float64) * gain, F.col("samples"), F.col("gain"))).drop("_peak")


def quiet_cut(x: np.ndarray, target: int, width: int, radius: int) -> int:
    """Start of the quietest window within the radius of the target, the earliest of equals."""
    low, high = max(width, target - radius), min(len(x) - width, target + radius)
    if high <= low:
        return min(target, len(x))
    hop, best = max(1, width // 4), (np.inf, target)
    step = hop * max(1, BLOCK // width)
    for a in range(low, high, step):
        starts = np.arange(a, min(high, a + step), hop)
        part = x[a : starts[-1] + width].astype(np.float64)
        energy = np.sqrt(np.mean(np.lib.stride_tricks.sliding_window_view(part * part, width)[::hop], axis=1))
        k = int(np.argmin(energy))
        if energy[k] < best[0]:
            best = (float(energy[k]), int(starts[k]))
    return best[1]


def _cut_sizes(sr: int, target_s: float, radius_s: float) -> tuple[int, int, int]:
    return int(target_s * sr), max(1, int(0.02 * sr)), int(radius_s * sr)


def quiet_cutpoint(signals: DataFrame, sr: int, target_s: float = ANCHOR_S, radius_s: float = RADIUS_S) -> DataFrame:
    """id, n, cut."""
    sizes = _cut_sizes(sr, target_s, radius_s)
    return signals.select("id", F.size("samples").alias("n"), _figures(lambda x: (quiet_cut(x, *sizes),), {"cut": "int"}, F.col("samples"))["cut"].alias("cut"))


def pcm_digests(x: np.ndarray, cut: int) -> tuple[str, str]:
    """SHA-256 of the whole signal and of its samples before the cut, in 16 bits, as numbers joined by commas; read block by block."""
    whole, anchor = hashlib.sha256(), hashlib.sha256()
    for a in range(0, len(x), BLOCK):
        scaled = x[a : a + BLOCK].astype(np.float64) * 32768
        level = np.clip(np.sign(scaled) * np.floor(np.abs(scaled) + 0.5), -32768, 32767).astype(np.int64).tolist()
        text = ("," if a else "") + ",".join(map(str, level))
        whole.update(text.encode())
        if a + BLOCK <= cut:
            anchor.update(text.encode())
        elif a < cut:
            anchor.update((("," if a else "") + ",".join(map(str, level[: cut - a]))).encode())
    return whole.hexdigest(), anchor.hexdigest()


def voice_anchor(signals: DataFrame, sr: int, target_s: float = ANCHOR_S, radius_s: float = RADIUS_S) -> DataFrame:
    """id, source_sha256, anchor_sha256, sample_rate, frames, duration_seconds, peak of the prefix up to the quiet cut; empty prefixes are left out."""
    sizes = _cut_sizes(sr, target_s, radius_s)

    def kernel(x: np.ndarray) -> tuple | None:
        cut = quiet_cut(x, *sizes)
        return (*pcm_digests(x, cut), cut, *_peak(x[:cut])) if cut > 0 else None

    found = _figures(kernel, {"source_sha256": "string", "anchor_sha256": "string", "frames": "long", "peak": "double"}, F.col("samples"))
    rows = signals.select("id", found.alias("a")).filter("a IS NOT NULL")
    return rows.select("id", "a.source_sha256", "a.anchor_sha256", F.lit(sr).alias("sample_rate"), "a.frames", (F.col("a.frames") / sr).alias("duration_seconds"), "a.peak")


def anchors(signals: DataFrame, sr: int, target_s: float = ANCHOR_S, radius_s: float = RADIUS_S) -> DataFrame:
    """``signals`` cut to their prefix up to the quiet cut; empty prefixes are left out."""
    sizes = _cut_sizes(sr, target_s, radius_s)
    rows = signals.withColumn("_cut", _figures(lambda x: (quiet_cut(x, *sizes),), {"cut": "int"}, F.col("samples"))["cut"])
    return rows.filter("_cut > 0").withColumn("samples", F.slice("samples", F.lit(1), F.col("_cut"))).drop("_cut")


def join_signals(signals: DataFrame, placed: DataFrame) -> DataFrame:
    """doc_id, chunk_index, from_sample, samples: each document's recording in pieces that follow each other without a gap, silence as zeros.

    ``signals``: doc_id, chunk_index, samples; ``placed``: rows of timeline.layout(). A
    chunk's piece has the zeros behind it, the first one also those before it.
    """
    spans = placed.select("doc_id", "chunk_index", "from_sample", F.coalesce("inserted", F.lit(0)).alias("_behind"), F.when(F.col("chunk_index") == 1, F.col("lead")).otherwise(0).alias("_ahead"))
    rows = signals.select("doc_id", "chunk_index", F.col("samples").cast("array<double>").alias("samples")).join(spans.hint("shuffle_merge"), ["doc_id", "chunk_index"])
    zeros = lambda n: F.array_repeat(F.lit(0.0), F.col(n).cast("int"))
    return rows.select("doc_id", "chunk_index", (F.col("from_sample") - F.col("_ahead")).alias("from_sample"), F.concat(zeros("_ahead"), "samples", zeros("_behind")).alias("samples"))


def explode_samples(signals: DataFrame, *keys: str) -> DataFrame:
    """keys, i, x: a row for each sample, for those who want to see them."""
    return signals.select(*keys, F.posexplode("samples").alias("i", "x"))
