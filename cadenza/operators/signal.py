"""Sample tables: windows of energy, trimming, fades, shared gain, anchors.

Signals are packed (id, sr, samples array<float>) or long (id, i, x, and n, the
signal's length). The long form keeps arithmetic in generated code; per-signal
figures are partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cadenza.sources.shared import written

#: Fixed values, in ms, seconds or amplitude.
THRESHOLD, WINDOW_MS, KEEP_START_MS, KEEP_END_MS, FADE_MS, PEAK = 0.008, 20, 100, 80, 4, 0.95
ANCHOR_S, RADIUS_S = 15.0, 1.5


def samples_in(sr: int, ms: float) -> int:
    """Samples in so many ms, halves to even."""
    return round(sr * ms / 1000)


def explode_samples(signals: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Long form: keys, n, i, x."""
    return signals.select(*keys, F.size("samples").alias("n"), F.posexplode("samples").alias("i", "x")).withColumn("x", F.col("x").cast("double"))


def downmix(samples: DataFrame) -> DataFrame:
    """Mean over channels: id, i, x."""
    return samples.groupBy("id", "i").agg(F.avg("x").alias("x"))


def validate_signals(signals: DataFrame, expected_sr: int) -> DataFrame:
    """``signals`` (with channels) and reason, null if the signal is sound."""
    odd = F.exists("samples", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    reason = (
        F.when(F.col("sr") != expected_sr, F.concat(F.lit("the rate is "), F.col("sr").cast("string"), F.lit(f", not {expected_sr}")))
        .when(F.col("channels") != 1, "there is more than one channel")
        .when(F.coalesce(F.size("samples"), F.lit(0)) <= 0, "there are no samples")
        .when(odd, "a sample is NaN or infinite")
    )
    return signals.withColumn("reason", reason)


def rms_windows(samples: DataFrame, sr: int, window_ms: float = WINDOW_MS) -> DataFrame:
    """id, n, w, start, size, rms of windows that don't overlap; a short last one counts."""
    width = max(1, samples_in(sr, window_ms))
    rows = samples.groupBy("id", "n", F.floor(F.col("i") / width).alias("w")).agg(F.count("*").alias("size"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
    return rows.withColumn("start", F.col("w") * width)


def detect_activity(samples: DataFrame, sr: int, threshold: float = THRESHOLD, window_ms: float = WINDOW_MS) -> DataFrame:
    """id, n, start, end of what is louder than the threshold; signals without any are left out (see silent_signals)."""
    loud = rms_windows(samples, sr, window_ms).filter(F.col("rms") > threshold)
    return loud.groupBy("id", "n").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"))


def silent_signals(signals: DataFrame, activity: DataFrame) -> DataFrame:
    return signals.select("id").distinct().join(activity.select("id").hint("shuffle_merge"), "id", "left_anti").withColumn("reason", F.lit("nothing in the signal is louder than the threshold"))


def trim_silence(samples: DataFrame, sr: int, keep_start_ms: float = KEEP_START_MS, keep_end_ms: float = KEEP_END_MS, threshold: float = THRESHOLD, window_ms: float = WINDOW_MS) -> DataFrame:
    """Long form cropped to its activity and margins, with the activity's new offsets: id, n, i, x, start, end."""
    act = detect_activity(samples, sr, threshold, window_ms)
    low = F.greatest(F.lit(0), F.col("start") - samples_in(sr, keep_start_ms))
    high = F.least(F.col("n"), F.col("end") + samples_in(sr, keep_end_ms))
    crop = act.select("id", low.alias("_low"), high.alias("_high"), (F.col("start") - low).alias("start"), (F.col("end") - low).alias("end"))
    rows = samples.join(crop.hint("shuffle_merge"), "id").filter((F.col("i") >= F.col("_low")) & (F.col("i") < F.col("_high")))
    return rows.select("id", (F.col("_high") - F.col("_low")).cast("int").alias("n"), (F.col("i") - F.col("_low")).cast("int").alias("i"), "x", "start", "end")


def fade_factor(i: Column, n: Column, fade: int) -> Column:
    """Linear ramp up over the first and down over the last min(fade, n div 4) samples."""
    m = F.least(F.lit(fade), F.floor(n / 4)).cast("int")
    up = F.when(m == 1, 0.0).otherwise(i / F.greatest(m - 1, F.lit(1)))
    down = F.when(m == 1, 1.0).otherwise((n - 1 - i) / F.greatest(m - 1, F.lit(1)))
    return F.when(i < m, up).otherwise(1.0) * F.when(i >= n - m, down).otherwise(1.0)


def edge_fade(samples: DataFrame, sr: int, fade_ms: float = FADE_MS) -> DataFrame:
    return samples.withColumn("x", F.col("x") * fade_factor(F.col("i"), F.col("n"), samples_in(sr, fade_ms)))


def render_chunks(samples: DataFrame, sr: int) -> DataFrame:
    """Trimmed and faded (a change of tempo between the two is an outside tool's work)."""
    return edge_fade(trim_silence(samples, sr).drop("start", "end"), sr)


def _peaks(samples: DataFrame, doc_col: str) -> DataFrame:
    """Each document's largest amplitude; NaN counts as larger than all numbers."""
    return samples.groupBy(doc_col).agg(F.max(F.abs("x")).alias("_peak"))


def _usable() -> Column:
    return (F.col("_peak") > 0) & (F.col("_peak") < float("inf"))


def normalize_peak(samples: DataFrame, doc_col: str = "doc_id", target: float = PEAK) -> DataFrame:
    """One gain for each document: target / its largest amplitude; the documents of documents_without_peak() are left out.

    The peaks are written first: Spark then knows their size when it picks the join, and can split a long document.
    """
    peak = written(_peaks(samples, doc_col).filter(_usable()), "peaks")
    return samples.join(peak, doc_col).withColumn("gain", F.lit(target) / F.col("_peak")).withColumn("x", F.col("x") * F.col("gain")).drop("_peak")


def documents_without_peak(samples: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """doc_id, reason of documents that no gain can bring to a level: silent ones and ones with NaN or infinite samples."""
    peak = F.col("_peak")
    reason = F.when(peak.isNull(), "there are no samples").when(peak == 0, "all samples are zero").otherwise("a sample is NaN or infinite")
    return _peaks(samples, doc_col).filter(~F.coalesce(_usable(), F.lit(False))).select(doc_col, reason.alias("reason"))


def quiet_cutpoint(samples: DataFrame, sr: int, target_s: float = ANCHOR_S, radius_s: float = RADIUS_S) -> DataFrame:
    """id, n, cut: start of the quietest window within the radius of the target, the earliest of equals.

    The windows start on a grid, so they are made by exploding each sample into
    the few windows that hold it and grouping, which partial aggregates shrink.
    """
    target, width, radius = int(target_s * sr), max(1, int(0.02 * sr)), int(radius_s * sr)
    hop, low = max(1, width // 4), max(max(1, int(0.02 * sr)), target - radius)
    high = F.least(F.col("n") - width, F.lit(target + radius))
    first = F.ceil((F.col("i") - (width - 1) - low) / hop)
    grid = F.sequence(F.greatest(F.lit(0), first).cast("int"), F.floor((F.col("i") - low) / hop).cast("int"))
    near = samples.filter((F.col("i") >= low) & (F.col("i") < high + width)).withColumn("k", F.explode(grid)).withColumn("at", F.col("k") * hop + low)
    energy = near.filter(F.col("at") < high).groupBy("id", "at").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
    best = energy.groupBy("id").agg(F.min(F.struct("rms", "at")).alias("b")).select("id", F.col("b.at").alias("_at"))
    lengths = samples.groupBy("id").agg(F.max("n").alias("n"))
    return lengths.join(best.hint("shuffle_merge"), "id", "left").select("id", "n", F.when(high <= low, F.least(F.lit(target), F.col("n"))).otherwise(F.coalesce("_at", F.lit(target))).cast("int").alias("cut"))


def voice_anchor(samples: DataFrame, sr: int, target_s: float = ANCHOR_S, radius_s: float = RADIUS_S) -> DataFrame:
    """id, source_sha256, anchor_sha256, sample_rate, frames, duration_seconds, peak of the prefix up to the cut; empty prefixes are left out.

    The hashes are of the samples in 16 bits, as numbers joined by commas: of the whole
    signal and of the anchor.
    """
    cut = quiet_cutpoint(samples, sr, target_s, radius_s).select("id", "cut")
    marked = samples.join(cut.hint("shuffle_merge"), "id")
    inside = F.col("i") < F.col("cut")
    level = F.least(F.greatest(F.round(F.col("x") * 32768).cast("int"), F.lit(-32768)), F.lit(32767))
    ordered = marked.groupBy("id", "cut").agg(F.max(F.when(inside, F.abs("x"))).alias("peak"), F.array_sort(F.collect_list(F.struct("i", level.alias("v")))).alias("_s"))
    digest = lambda of: F.sha2(F.array_join(F.transform(of, lambda s: s["v"].cast("string")), ","), 256)
    frames = F.size(F.filter("_s", lambda s: s["i"] < F.col("cut")))
    return ordered.filter("peak IS NOT NULL").select(
        "id", digest(F.col("_s")).alias("source_sha256"), digest(F.filter("_s", lambda s: s["i"] < F.col("cut"))).alias("anchor_sha256"),
        F.lit(sr).alias("sample_rate"), frames.cast("long").alias("frames"), (frames / sr).alias("duration_seconds"), "peak",
    )
