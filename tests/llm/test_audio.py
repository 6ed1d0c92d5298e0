import hashlib
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from tilewright.llm import audio as A


def slow_mulaw(code):
    code = ~code & 0xFF
    size = (((code & 15) * 2 + 33) << (code >> 4 & 7)) - 33
    return -size * 4 if code & 0x80 else size * 4


def slow_alaw(code):
    code ^= 0x55
    part, low = code >> 4 & 7, code & 15
    size = (2 * low + 1) * 8 if part == 0 else (2 * low + 33) * 8 << part - 1
    return size if code & 0x80 else -size


def test_tables():
    assert A.mulaw_table().tolist() == [slow_mulaw(c) for c in range(256)]
    assert A.alaw_table().tolist() == [slow_alaw(c) for c in range(256)]
    assert A.mulaw_table()[0] == -32124 and A.alaw_table()[0x2A] == -32256


def slow_ima(data, block):
    out = []
    for at in range(0, len(data) - block + 1, block):
        b = data[at : at + block]
        now, index = int.from_bytes(b[:2], "little", signed=True), min(b[2], 88)
        out.append(now)
        for byte in b[4:]:
            for nibble in (byte & 15, byte >> 4):
                step = A.IMA_STEPS[index]
                change = step >> 3
                if nibble & 1:
                    change += step >> 2
                if nibble & 2:
                    change += step >> 1
                if nibble & 4:
                    change += step
                now = max(-32768, min(32767, now - change if nibble & 8 else now + change))
                index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][nibble & 7]))
                out.append(now)
    return out


def test_adpcm_blocks_side_by_side():
    data = np.random.default_rng(0).integers(0, 256, 64 * 5, dtype=np.uint8).tobytes()
    assert A.ima_decode(data, 64).tolist() == slow_ima(data, 64)


def test_adpcm_comes_back_near():
    t = np.arange(4000)
    x = (8000 * np.sin(t / 9) + 3000 * np.sin(t / 31)).astype(np.int16)
    y = A.ima_decode(A.ima_encode(x), 256)[:4000]
    assert np.sqrt(((y - x.astype(float)) ** 2).mean()) < 400


def test_files_of_all_kinds(spark):
    pcm = np.arange(-500, 500, dtype="<i2")
    media = [A.wav(bytes(range(256))), A.wav(bytes(range(256)), A.ALAW), A.wav(A.ima_encode(pcm), A.IMA_ADPCM, block=256, bits=4), A.wav(pcm.tobytes(), A.PCM, block=2, bits=16), b"junk", None, b""]
    df = spark.createDataFrame([(i, bytearray(m) if m is not None else None, 1) for i, m in enumerate(media)], "k int, media binary, samples int")
    got = {r.k: r for r in A.decode_column(df, "k", "media").collect()}
    assert [got[i].rate for i in range(4)] == [16000] * 4 and all(got[i].error for i in (4, 5, 6))
    assert np.frombuffer(got[0].pcm, "<i2")[::2].tolist() == A.mulaw_table().tolist()
    assert np.frombuffer(got[3].pcm, "<i2")[::2].tolist() == pcm.tolist()


def test_resampling_keeps_a_tone():
    t = np.arange(800)
    x = (9000 * np.sin(2 * np.pi * 440 * t / 8000)).astype(np.int16)
    want = 9000 * np.sin(2 * np.pi * 440 * np.arange(1600) / 16000)
    assert abs(A.double_rate(x)[20:-20] - want[20:-20]).max() < 250


@pytest.mark.parametrize("text", [None, "", "a", "x" * 64, "é" * 40, "long " * 40_000])
def test_payload_comes_back(spark, text):
    raw = (text or "").encode()
    padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
    df = spark.createDataFrame([(1, text, 3)], "doc_id long, text string, n_bytes int")
    r = A.media_digest(A.store_text(df)).first()
    assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    file = A.store_text(df).first().media
    assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())


def test_all_three_formats(spark):
    texts = [f"text {i} " * (i % 40) for i in range(90)] + ["again"] * 3
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in enumerate(texts)], "doc_id long, text string, media int, samples int, n_bytes int")
    table = A.store_text(df)
    rows = {r.doc_id: bytes(r.media) for r in table.collect()}
    assert {A.chunks(m)["tag"] for m in rows.values()} == {A.MULAW, A.ALAW, A.IMA_ADPCM}
    assert all(A.unpack(rows[i]) == A.payload(t)[0] for i, t in enumerate(texts))
    for (samples, rate), (i, m) in zip(A._expanded([rows[i] for i in sorted(rows)]), sorted(rows.items())):
        x = A.chunks(m)
        want = slow_ima(x["data"], x["block"]) if x["tag"] == A.IMA_ADPCM else [{A.MULAW: slow_mulaw, A.ALAW: slow_alaw}[x["tag"]](c) for c in x["data"]]
        assert samples.tolist() == want and rate == 8000
    pcm = {r.doc_id: r for r in A.decode_column(table, "doc_id", "media").collect()}
    assert all(np.frombuffer(pcm[i].pcm, "<i2")[::2].tolist() == A.expand(m)[0].tolist() and pcm[i].rate == 16000 for i, m in rows.items())
    got = {r.doc_id: r for r in A.media_digest(table).collect()}
    assert got[90][1:] == got[91][1:] == got[92][1:] and got[3].feature.startswith(f"n={pcm[3].samples};")


def test_the_query_stores_its_pcm(spark, monkeypatch):
    """Decoded, resampled and written as a table of its own, from which the features are taken."""
    tables, cut = {}, A.cut
    monkeypatch.setattr(A, "cut", lambda df, name, *codec: tables.setdefault(name, cut(df, name, *codec)))
    texts = [None, "", *(f"text {i} " * i for i in range(20))]
    got = {r.doc_id: r for r in A.media_digest(A.store_text(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    assert set(tables) == {"media", "pcm"}
    stored = {r.doc_id: r for r in tables["pcm"].collect()}
    for r in tables["media"].collect():
        samples, rate = A.expand(bytes(r.media))
        sound = np.frombuffer(stored[r.doc_id].pcm, "<i2")
        assert sound.tolist() == A.double_rate(samples).tolist() and stored[r.doc_id].rate == 2 * rate
        x = sound.astype(float)
        want = f"n={len(x)};rms={int(np.sqrt((x * x).mean()))};mean={int(x.sum() // len(x))};peak={int(abs(x).max())};turns={sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:]))}"
        assert got[r.doc_id].feature == want


def test_pcm_is_made_in_turns(spark, monkeypatch):
    """Every row once, as in one go, and no turn's PCM is there beside another's."""
    texts = [None, "", *(f"text {i} " * i for i in range(200))]
    monkeypatch.setattr(A, "FILE", 8)
    media = A.store_text(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    whole = sorted(A.media_digest(media).collect())
    alive, most, cut, drop = set(), [], A.cut, A.drop

    def watched(df, name, *rest):
        got = cut(df, name, *rest)
        if name == "pcm":
            alive.add(got)
            most.append(len(alive))
        return got

    def dropped(df):
        drop(df)
        alive.remove(df)
        with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
            df.collect()

    monkeypatch.setattr(A, "cut", watched)
    monkeypatch.setattr(A, "drop", dropped)
    monkeypatch.setattr(A, "TURN", 1 << 12)
    assert sorted(A.media_digest(media).collect()) == whole and len(whole) == 202
    assert most == [1] * A.TURNS and not alive
    assert len(A.turns(spark.createDataFrame([(1, 9 << 30)], "doc_id long, n_bytes long"))) == 1  # in no files


def test_tables_have_few_files_and_small_row_groups(spark, monkeypatch):
    """A file costs the executor two processes, a row group is held in memory: one file a task, and PCM in parts."""
    files, blocks, cut = {}, [], A.cut

    def watched(df, name, *rest):
        got = cut(df, name, *rest)
        names = [f.removeprefix("file://") for f in got.inputFiles()]
        files[name] = files.get(name, 0) + len(names)
        if name == "pcm":
            blocks.extend(pq.ParquetFile(f).num_row_groups for f in names)
        return got

    monkeypatch.setattr(A, "cut", watched)
    monkeypatch.setattr(A, "TURN", 1 << 16)
    monkeypatch.setattr(A, "BLOCK", 1 << 17, raising=False)
    texts = [(i, f"text {i} {i * 7919 % 10007} " * (i % 9)) for i in range(9000)]
    got = A.media_digest(A.store_text(spark.createDataFrame(texts, "doc_id long, text string").repartition(3))).select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == list(range(9000))
    assert files["media"] == files["pcm"] == 3 and files["digest"] <= 3 and min(blocks) > 1


def test_no_rows(spark):
    assert A.media_digest(A.store_text(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
