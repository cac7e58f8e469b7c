import io
import struct
import wave

from callweave.plans import manifests
from callweave.sources import files


def _wav(frames, before=b"", after=b""):
    """A file of 8 kHz, 16 bit, with chunks put before and after its data chunk and a RIFF size that covers all."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"\1\0" * frames)
    c = out.getvalue()
    body = c[12:36] + before + c[36:] + after
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WAVE" + body


def _chunk(name, n, stated=None):
    return name + struct.pack("<I", n if stated is None else stated) + bytes(n)


def test_chunks_beyond_64_kb_are_followed(spark, tmp_path):
    cut = _chunk(b"LIST", 10, 500)
    for name, content in {
        "late": _wav(8000, before=_chunk(b"LIST", 70_001) + b"\0"),
        "tail": _wav(40_000, after=_chunk(b"LIST", 10)),
        "torn": _wav(40_000, after=cut),
        "beyond": _wav(40_000) + cut,  # after the RIFF boundary
        "none": _wav(0)[:36] + _chunk(b"LIST", 70_000),
    }.items():
        if name == "none":
            content = content[:4] + struct.pack("<I", len(content) - 8) + content[8:]
        (tmp_path / f"{name}.wav").write_bytes(content)
    got = files.wav_headers(spark, str(tmp_path))
    h = {r.path.rsplit("/", 1)[-1][:-4]: r for r in got.collect()}
    assert {k: r.riff_status for k, r in h.items()} == {"late": "ok", "tail": "ok", "torn": "truncated_chunk", "beyond": "ok", "none": "missing_data_chunk"}
    assert (h["late"].frames, h["late"].duration_s, h["late"].error) == (8000, 1.0, None) and h["torn"].frames == h["tail"].frames == 40_000
    assert h["none"].frames is None and h["none"].error and h["late"].size_bytes == (tmp_path / "late.wav").stat().st_size
    labels = spark.createDataFrame([("/x/late.json", "F", [(1, 0, 900), (1, 500, 1500)])], "path string, gender string, utterances array<struct<speaker int, startAt bigint, endAt bigint>>")
    assert [r.exceeds_wav for r in manifests.audit_segments(labels, got).orderBy("position").collect()] == [False, True]
