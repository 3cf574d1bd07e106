"""Sound files: RIFF/WAVE bytes to packed signals, and back.

Reading takes whole files as Spark's binaryFile source gives them. Writing streams the
pieces of a document, in order, into one file of 32-bit floats, so a task holds one
batch of pieces and never a recording.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cadenza.sources.shared import written

#: Fixed values of the format: kinds of samples.
PCM, IEEE_FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
SUBTYPES = {(PCM, 8): "PCM_U8", (PCM, 16): "PCM_16", (PCM, 24): "PCM_24", (PCM, 32): "PCM_32", (IEEE_FLOAT, 32): "FLOAT", (IEEE_FLOAT, 64): "DOUBLE"}
MOST_BYTES = (1 << 32) - 1
FIELDS = "path string, stem string, sha256 string, subtype string, channels int, rate int, frames long, finite boolean, samples array<float>, reason string"


def header(frames: int, rate: int) -> bytes:
    """What stands before the samples of a mono file of 32-bit floats."""
    size = 4 * frames
    if size + 50 > MOST_BYTES:
        raise ValueError("a recording is too long for one file")
    fmt = struct.pack("<HHIIHHH", IEEE_FLOAT, 1, rate, 4 * rate, 4, 32, 0)
    return b"RIFF" + struct.pack("<I", size + 50) + b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, frames) + b"data" + struct.pack("<I", size)


def _chunks(raw: memoryview):
    """Name and content of each chunk; an error where one ends behind the file."""
    at = 12
    while at + 8 <= len(raw):
        name, size = bytes(raw[at : at + 4]), struct.unpack("<I", raw[at + 4 : at + 8])[0]
        if at + 8 + size > len(raw):
            raise ValueError(f"the file ends within its chunk {name.decode('latin-1')!r}")
        yield name, raw[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def _decoded(data: memoryview, subtype: str) -> np.ndarray:
    """Samples as floats, whole numbers by their full scale."""
    if subtype in ("FLOAT", "DOUBLE"):
        return np.frombuffer(data, "<f4" if subtype == "FLOAT" else "<f8").astype(np.float32)
    if subtype == "PCM_U8":
        return (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    if subtype == "PCM_24":
        parts = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        whole = (parts[:, 0] << 8 | parts[:, 1] << 16 | parts[:, 2] << 24) >> 8
        return whole.astype(np.float32) / (1 << 23)
    whole = np.frombuffer(data, "<i2" if subtype == "PCM_16" else "<i4")
    return (whole / (1 << 15 if subtype == "PCM_16" else 1 << 31)).astype(np.float32)


def parse(raw: bytes) -> dict:
    """subtype, channels, rate, frames, finite, samples (the mean of the channels) and reason (null for a sound file) of a file's bytes."""
    out = dict.fromkeys(("subtype", "channels", "rate", "frames", "finite", "samples", "reason"))
    try:
        view = memoryview(raw)
        if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
            raise ValueError("the file is no RIFF/WAVE file")
        fmt = data = None
        for name, content in _chunks(view):
            fmt = content if name == b"fmt " else fmt
            data = content if name == b"data" and data is None else data
        if fmt is None or len(fmt) < 16:
            raise ValueError("the file has no format")
        kind, channels, rate, _, frame, bits = struct.unpack("<HHIIHH", fmt[:16])
        if kind == EXTENSIBLE and len(fmt) >= 26:
            kind = struct.unpack("<H", fmt[24:26])[0]
        out |= {"channels": channels, "rate": rate if rate < 1 << 31 else None, "subtype": SUBTYPES.get((kind, bits))}
        if out["subtype"] is None:
            raise ValueError(f"samples of kind {kind} with {bits} bits are not known")
        if data is None:
            raise ValueError("the file has no samples")
        if not channels or frame != channels * bits // 8 or len(data) % frame:
            raise ValueError("the samples are no whole frames")
        samples = _decoded(data, out["subtype"])
        out |= {"frames": len(samples) // channels, "finite": bool(np.isfinite(samples).all())}
        with np.errstate(invalid="ignore"):
            out["samples"] = samples if channels == 1 else samples.reshape(-1, channels).mean(axis=1, dtype=np.float64).astype(np.float32)
    except ValueError as e:
        out["reason"] = str(e)
    return out


def _read(batches):
    for batch in batches:
        rows = []
        for path, stem, content in zip(*(batch.column(c) for c in ("path", "stem", "content"))):
            raw = content.as_buffer()
            rows.append({"path": path.as_py(), "stem": stem.as_py(), "sha256": hashlib.sha256(raw).hexdigest()} | parse(raw))
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<float>": pa.list_(pa.float32())}
        fields = [f.split(" ") for f in FIELDS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[name] for r in rows], kinds[kind]) for name, kind in fields], [name for name, _ in fields])


def read_sounds(spark: SparkSession, path: str) -> DataFrame:
    """path, stem (name without folder and ending), sha256 of the bytes, subtype, channels, rate, frames, finite, samples, reason.

    A file that can't be read has a reason and nulls for what is not known of it.
    """
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), "content").mapInArrow(_read, FIELDS)


def _write(folder: str):
    def run(batches):
        files, root = pyarrow.fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        now: dict | None = None

        def close() -> pa.RecordBatch:
            now["file"].close()
            if now["seen"] != now["frames"]:
                raise ValueError(f"{now['name']}: {now['seen']} of {now['frames']} samples")
            files.move(now["part"], f"{root}/{now['name']}")  # all of it appears at once
            return pa.RecordBatch.from_arrays([pa.array([now[c]]) for c in ("doc_id", "name", "frames")] + [pa.array([now["digest"].hexdigest()])], ["doc_id", "name", "frames", "sha256"])

        def put(raw: bytes) -> None:
            now["file"].write(raw)
            now["digest"].update(raw)

        for batch in batches:
            lists = batch.column("samples")
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for k, (doc, name, frames, rate) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "name", "_frames", "sr")))):
                if now is None or now["name"] != name:
                    if now is not None:
                        yield close()
                    part = f"{root}/.{name}-{uuid.uuid4().hex}"
                    now = {"doc_id": doc, "name": name, "frames": frames, "part": part, "file": files.open_output_stream(part), "seen": 0, "digest": hashlib.sha256()}
                    put(header(frames, rate))
                own = flat[offsets[k] : offsets[k + 1]].astype("<f4")
                now["seen"] += len(own)
                put(own.tobytes())
        if now is not None:
            yield close()

    return run


def write_sounds(pieces: DataFrame, names: DataFrame, sr: int, folder: str) -> DataFrame:
    """Write a file of 32-bit floats for each document, and return doc_id, name, frames, sha256 of what was written.

    ``pieces``: doc_id, from_sample, samples, as packed.join_signals() has them; ``names``:
    doc_id, name, and sr where it is not the same for all. ``folder`` is a URI that all
    executors see. A file is written under a name of its own and moved to its place when it
    is whole, so a task that is lost or repeated leaves no half of a recording.
    """
    total = F.sum(F.size("samples")).over(Window.partitionBy("doc_id")).alias("_frames")
    names = names.select("doc_id", "name", (F.col("sr") if "sr" in names.columns else F.lit(sr)).alias("sr"))
    rows = pieces.select("doc_id", "from_sample", "samples").join(names.hint("shuffle_merge"), "doc_id")
    rows = rows.select("doc_id", "name", "from_sample", total, "sr", F.col("samples").cast("array<float>").alias("samples"))
    rows = rows.repartition("doc_id").sortWithinPartitions("doc_id", "name", "from_sample")
    return written(rows.mapInArrow(_write(folder), "doc_id long, name string, frames long, sha256 string"), "sounds")
