"""MPEG transport streams as a media column.

``demux`` reads a binary column of transport streams (ISO/IEC 13818-1): it
locates packets of 188, 192 or 204 bytes and finds them again after every loss
of lock, follows the program association and map tables with their versions,
checks continuity counters, reassembles the packetised elementary stream (PES)
packets of each elementary stream, and stores their timestamps with
random-access points. Packets are read as a matrix of 188 bytes a row, so headers of a whole
stream are decoded with a few array operations. ``mux`` writes such streams; the
query muxes every document's text, since the tables hold no video, and demuxes
it again, which must give the text back.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .shared import text_batches

PACKET, SYNC = 188, 0x47
#: Distances of packets: plain, with a time stamp before each, with parity after each. Packets are where so many sync bytes stand in line.
PITCHES, LOCK = (188, 192, 204), 5
#: Stream ids whose PES packets have no optional header.
BARE_IDS = {0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF}
PMT_PID, VIDEO_PID, AUDIO_PID = 0x1000, 0x100, 0x101
VIDEO_TYPE, AUDIO_TYPE = 0x1B, 0x0F
FRAME, GOP, TICKS = 1000, 12, 3600

SCHEMA = """doc_id long, status string, n_packets long, program int, pid int, stream_type int, n_es_packets long,
 cc_errors long, n_bytes long, digest string,
 pes array<struct<pts: long, dts: long, random_access: boolean, complete: boolean, first_byte: long, n_bytes: long>>"""
_PES = pa.struct([("pts", pa.int64()), ("dts", pa.int64()), ("random_access", pa.bool_()), ("complete", pa.bool_()), ("first_byte", pa.int64()), ("n_bytes", pa.int64())])
_COLUMNS = [("doc_id", pa.int64()), ("status", pa.string()), ("n_packets", pa.int64()), ("program", pa.int32()), ("pid", pa.int32()), ("stream_type", pa.int32()), ("n_es_packets", pa.int64()), ("cc_errors", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("pes", pa.list_(_PES))]

_CRC_TABLE = []
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = ((_c << 1) ^ 0x04C11DB7 if _c & 0x80000000 else _c << 1) & 0xFFFFFFFF
    _CRC_TABLE.append(_c)


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC_TABLE[(c >> 24) ^ b]
    return c


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, ident >> 8, ident & 255, 0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


_PAT = _section(0, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))
_PMT = _section(2, 1, bytes([0xE0 | VIDEO_PID >> 8, VIDEO_PID & 255, 0xF0, 0, VIDEO_TYPE, 0xE0 | VIDEO_PID >> 8, VIDEO_PID & 255, 0xF0, 0, AUDIO_TYPE, 0xE0 | AUDIO_PID >> 8, AUDIO_PID & 255, 0xF0, 0]))


def _stamp(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | (t >> 29) & 14 | 1, (t >> 22) & 255, (t >> 14) & 254 | 1, (t >> 7) & 255, (t << 1) & 254 | 1])


def _packets(pid: int, payload: bytes, cc: int, random_access: bool) -> tuple[list[bytes], int]:
    """One PES packet or section in transport packets; the last is stuffed in its adaptation field."""
    out, at, first = [], 0, True
    while first or at < len(payload):
        flags = 0x40 if random_access and first else 0
        room = 184 - (2 if flags else 0)
        take = min(room, len(payload) - at)
        head = bytes([SYNC, (0x40 if first else 0) | pid >> 8, pid & 255])
        if take == 184:
            out.append(head + bytes([0x10 | cc]) + payload[at : at + take])
        else:
            n = 183 - take  # length of the adaptation field
            field = bytes([n]) + (bytes([flags]) + b"\xff" * (n - 1) if n else b"")
            out.append(head + bytes([0x30 | cc]) + field + payload[at : at + take])
        at, first, cc = at + take, False, (cc + 1) & 15
    return out, cc


def mux(payload: bytes) -> bytes:
    """A stream with program tables, ``payload`` as video frames of FRAME bytes, and a checksum of each GOP as audio."""
    out, cc = [], {0: 0, PMT_PID: 0, VIDEO_PID: 0, AUDIO_PID: 0}

    def put(pid: int, data: bytes, ra: bool = False) -> None:
        got, cc[pid] = _packets(pid, data, cc[pid], ra)
        out.extend(got)

    for k, at in enumerate(range(0, len(payload), FRAME)):
        if k % GOP == 0:
            put(0, b"\0" + _PAT)
            put(PMT_PID, b"\0" + _PMT)
        frame, pts, dts = payload[at : at + FRAME], (k + 1) * TICKS, k * TICKS
        put(VIDEO_PID, b"\0\0\1\xe0\0\0\x80\xc0\x0a" + _stamp(3, pts) + _stamp(1, dts) + frame, k % GOP == 0)
        if k % GOP == 0:
            sound = zlib.crc32(payload[at : at + FRAME * GOP]).to_bytes(4, "big")
            put(AUDIO_PID, b"\0\0\1\xc0" + (8 + len(sound)).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(2, dts) + sound, True)
    return b"".join(out)


def _read_stamp(b: bytes) -> int:
    return (b[0] & 14) << 29 | b[1] << 22 | (b[2] & 254) << 14 | b[3] << 7 | b[4] >> 1


def _sections(payloads: list[bytes], starts: list[bool]) -> list[tuple[int, bytes]]:
    """Complete sections with a right checksum from the payloads of a table's packets, with the payload that ends each."""
    out, buf = [], None

    def drain(buf: bytes, k: int) -> bytes:
        while len(buf) >= 3 and buf[0] != 0xFF:
            n = 3 + ((buf[1] & 15) << 8 | buf[2])
            if len(buf) < n:
                break
            if n >= 12 and crc32_mpeg(buf[:n]) == 0:
                out.append((k, buf[:n]))
            buf = buf[n:]
        return buf

    for k, (p, s) in enumerate(zip(payloads, starts)):
        if s and p:
            first = 1 + p[0]
            if buf is not None:
                drain(buf + p[1:first], k)
            buf = drain(p[first:], k)
        elif buf is not None:
            buf = drain(buf + p, k)
    return out


def _run(sync: np.ndarray, at: int, pitch: int) -> int:
    """Sync bytes in line from ``at`` on, over whole packets."""
    most, n, step = max(0, (len(sync) - at - PACKET) // pitch + 1), 0, 64
    while n < most:
        line = sync[at + n * pitch : at + min(most, n + step) * pitch : pitch][: min(step, most - n)]
        if not line.all():
            return n + int(line.argmin())
        n, step = n + len(line), step * 2
    return n


def locate(arr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins of packets, and whether each is beside a loss of lock, so that its bytes may have shifted.

    Lock is where ``LOCK`` sync bytes stand in line, or as many as there are
    packets up to the end; of the places within one packet the one of the
    longest line counts, then the first. A packet without its sync byte among
    others that are in line keeps its place.
    """
    sync, n = arr == SYNC, len(arr)
    if n >= PACKET and n % PACKET == 0 and sync[::PACKET].all():
        return np.arange(0, n, PACKET), np.zeros(n // PACKET, bool)
    best: tuple[int, int, np.ndarray] | None = None
    for pitch in PITCHES:
        line = sync[: max(0, n - PACKET + 1)].copy()
        for k in range(1, LOCK):
            ahead = np.ones(len(line), bool)
            here = sync[k * pitch : k * pitch + len(line)]
            ahead[: len(here)] = here
            ahead[max(0, n - PACKET + 1 - k * pitch) :] = True  # no whole packet there
            line &= ahead
        places = np.flatnonzero(line)
        # Fewer than LOCK packets in line at the end prove less than a full line elsewhere.
        full = int((places <= n - PACKET - (LOCK - 1) * pitch).sum())
        if len(places) and (best is None or full > best[0]):
            best = full, pitch, places
    if best is None:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    _, pitch, places = best
    found, beside, at = [], [], 0
    while (k := int(np.searchsorted(places, at))) < len(places):
        near = places[k : int(np.searchsorted(places, places[k] + pitch))]
        runs = [_run(sync, int(x), pitch) for x in near] if len(near) > 1 else [_run(sync, int(near[0]), pitch)]
        begin, length = int(near[int(np.argmax(runs))]), max(runs)
        own = begin + pitch * np.arange(length)
        while True:  # a sync byte may be in error where others go on in line
            after = begin + pitch * length
            j = int(np.searchsorted(places, after + pitch))
            if j >= len(places) or places[j] != after + pitch or after + pitch > n - PACKET - (LOCK - 1) * pitch:
                break
            length += 1 + _run(sync, after + pitch, pitch)
            own = begin + pitch * np.arange(length)
        mark = np.zeros(len(own), bool)
        if found:
            mark[0] = False
            beside[-1][-1] = True
            if found[-1][-1] + PACKET > begin:  # its end belongs to what follows
                found[-1], beside[-1] = found[-1][:-1], beside[-1][:-1]
        found.append(own)
        beside.append(mark)
        at = int(own[-1]) + 1
        if int(own[-1]) + pitch + PACKET > n:
            break
    return np.concatenate(found), np.concatenate(beside)


def _epochs(sections: list[tuple[int, bytes]], n: int, read) -> list[tuple[int, int, dict]]:
    """(first row, end row, entries) of each version of a table; the first holds from the begin on, others from their section."""
    out: list[list] = []
    version = None
    for row, s in sections:
        if not s[5] & 1:  # announced, not yet in force
            continue
        if s[5] >> 1 & 31 != version:
            if out:
                out[-1][1] = row
            out.append([row if out else 0, n, {}])
            version = s[5] >> 1 & 31
        out[-1][2].update(read(s))
    return [tuple(x) for x in out]


def _read_pat(s: bytes) -> dict[int, int]:
    return {s[k] << 8 | s[k + 1]: (s[k + 2] & 31) << 8 | s[k + 3] for k in range(8, len(s) - 4, 4) if s[k] << 8 | s[k + 1]}


def _read_pmt(s: bytes) -> dict[int, int]:
    out, k = {}, 12 + ((s[10] & 15) << 8 | s[11])
    while k + 5 <= len(s) - 4:
        out[(s[k + 1] & 31) << 8 | s[k + 2]] = s[k]
        k += 5 + ((s[k + 3] & 15) << 8 | s[k + 4])
    return out


def parse(data: bytes) -> dict:
    """Program tables, continuity errors and PES packets of one transport stream.

    Bytes outside packets are skipped; packets without a sync byte, with the
    error flag or scrambled are counted and not used. A table holds from its
    section up to the next version, the first one from the begin on; packets of
    an elementary stream count while a table lists it.
    """
    arr = np.frombuffer(data, np.uint8)
    begins, shifted = locate(arr)
    n = len(begins)
    if not n:
        return {"status": "no packets" if len(arr) else "empty", "n_packets": 0, "streams": []}
    whole_line = n * PACKET == len(arr)
    m = arr.reshape(n, PACKET) if whole_line else arr[begins[:, None] + np.arange(PACKET)]
    good = (m[:, 0] == SYNC) & (m[:, 1] & 0x80 == 0) & (m[:, 3] & 0xC0 == 0)
    pid = (m[:, 1].astype(np.int32) & 31) << 8 | m[:, 2]
    start, cc = m[:, 1] & 0x40 > 0, m[:, 3] & 15
    has_field, has_load = m[:, 3] & 0x20 > 0, m[:, 3] & 0x10 > 0
    length = np.where(has_field, m[:, 4].astype(np.int64) + 1, 0)
    load_at = np.minimum(4 + length, PACKET)
    flags = np.where(has_field & (length > 1), m[:, 5], 0)
    jump, ra, clock = flags & 0x80 > 0, flags & 0x40 > 0, flags & 0x10 > 0

    def loads(rows: np.ndarray) -> list[bytes]:
        return [m[r, load_at[r] :].tobytes() if has_load[r] else b"" for r in rows]

    def table(p: int, table_id: int) -> list[tuple[int, bytes]]:
        rows = np.flatnonzero(good & (pid == p))
        return [(int(rows[k]), s) for k, s in _sections(loads(rows), list(start[rows])) if s[0] == table_id]

    listed: dict[tuple[int, int, int], np.ndarray] = {}
    maps: dict[tuple[int, int], list[tuple[int, int, dict]]] = {}
    for lo, hi, programs in _epochs(table(0, 0), n, _read_pat):
        for number, p in programs.items():
            if (number, p) not in maps:
                maps[number, p] = _epochs([x for x in table(p, 2) if x[1][3] << 8 | x[1][4] == number], n, _read_pmt)
            for a, b, kinds in maps[number, p]:
                for q, kind in kinds.items():
                    listed.setdefault((number, q, kind), np.zeros(n, bool))[max(lo, a) : min(hi, b)] = True
    out = []
    for (number, p, kind), on in sorted(listed.items()):
        rows = np.flatnonzero(good & on & (pid == p))
        step, loaded = (cc[rows][1:].astype(int) - cc[rows][:-1]) & 15, has_load[rows][1:]
        same = np.flatnonzero((step == 0) & loaded)  # a packet may be sent twice in a row, with another clock
        alike = m[rows[same + 1]] == m[rows[same]]
        alike[:, 6:12] |= clock[rows[same + 1]][:, None]
        twice = np.zeros(len(rows), bool)
        twice[same[alike.all(1)] + 1] = True
        wrong = np.zeros(len(rows), bool)
        wrong[1:] = (step != loaded) & ~jump[rows][1:] & ~twice[1:]
        # What is lost before a packet is known at the next one that has a payload; a shifted packet spoils its own.
        used = np.flatnonzero(has_load[rows] & ~twice)
        losses = np.concatenate([[0], np.cumsum(wrong)])
        lost = np.diff(np.concatenate([[0], losses[used + 1]])) > 0
        ended_short = losses[-1] > (losses[used[-1] + 1] if len(used) else 0)
        use = rows[used]
        firsts = np.flatnonzero(start[use])
        pes, at, payload = [], 0, []
        for a, b in zip(firsts, np.append(firsts[1:], len(use))):
            own = use[a:b]
            raw = b"".join(loads(own))
            whole = not lost[a + 1 : b].any() and not (lost[b] if b < len(use) else ended_short) and not shifted[own].any()
            if len(raw) < 9 or raw[:3] != b"\0\0\1":
                continue
            size = raw[4] << 8 | raw[5]
            bare = raw[3] in BARE_IDS
            body, has = (6, 0) if bare else (9 + raw[8], raw[7] >> 6)
            if size:
                whole &= len(raw) >= 6 + size
                raw = raw[: 6 + size]
            pts = _read_stamp(raw[9:14]) if has & 2 and len(raw) >= 14 else None
            dts = _read_stamp(raw[14:19]) if has == 3 and len(raw) >= 19 else pts
            es = raw[body:]
            pes.append((pts, dts, bool(ra[own[0]]), bool(whole), at, len(es)))
            at += len(es)
            payload.append(es)
        out.append({"program": number, "pid": p, "stream_type": kind, "n_es_packets": len(rows), "cc_errors": int(wrong.sum()), "pes": pes, "payload": b"".join(payload)})
    status = "ok" if out and good.all() and whole_line else "damaged" if out else "no program"
    return {"status": status, "n_packets": n, "streams": out}


def _rows(ids, parsed) -> pa.RecordBatch:
    cols: dict[str, list] = {c: [] for c, _ in _COLUMNS}
    for i, p in zip(ids, parsed):
        for s in p["streams"] or [None]:
            pes = s and [dict(zip(_PES.names, x)) for x in s["pes"]]
            row = (i, p["status"], p["n_packets"]) + ((s["program"], s["pid"], s["stream_type"], s["n_es_packets"], s["cc_errors"], len(s["payload"]), hashlib.md5(s["payload"]).hexdigest(), pes) if s else (None,) * 8)
            for (c, _), v in zip(_COLUMNS, row):
                cols[c].append(v)
    return pa.record_batch([pa.array(cols[c], t) for c, t in _COLUMNS], [c for c, _ in _COLUMNS])


def demux(streams: DataFrame, column: str = "ts", id_column: str = "doc_id") -> DataFrame:
    """One row for each elementary stream of each row: program, pid, stream type, packets, continuity errors,
    the reassembled bytes' number and MD5, and PES packets in order with timestamps and random-access marks.

    status is ``ok``; ``damaged`` (bytes outside packets of 188, or packets in error);
    ``no program`` (no readable tables), ``no packets``, ``empty`` or ``null``,
    each of which gives one row with null stream columns. A PES packet that a
    continuity error or a loss of lock touches, or that is shorter than it says,
    isn't complete. A stream that two programs list has a row for each. Streams
    of any length are read entire; an empty table gives no row. A null id stays
    null and repeated rows repeat their results; other columns are ignored,
    whatever their names.
    """

    def run(batches):
        for b in tv.batches(batches):
            ids, data = tv.column(b, 0).to_pylist(), tv.column(b, 1)
            for lo in range(0, len(ids), 200):
                part = [parse(x) if x is not None else {"status": "null", "n_packets": 0, "streams": []} for x in data.slice(lo, 200).to_pylist()]
                yield _rows(ids[lo : lo + 200], part)

    return streams.select(F.col(id_column).cast("long").alias("doc_id"), F.col(column).cast("binary").alias("ts")).mapInArrow(run, SCHEMA)


def mux_texts(docs: DataFrame) -> DataFrame:
    """doc_id, ts: each text's UTF-8 bytes as a transport stream, null for a null text and empty for an empty one.

    One row for each row, repeated ones and those with a null doc_id too; texts
    of any length are muxed entire; other columns are ignored.
    """

    def run(batches):
        for b in tv.batches(batches):
            ids, texts = tv.column(b, 0), tv.column(b, 1)
            for lo, hi in tv.slices(texts, 8 * tv.SLICE_BYTES):
                yield pa.record_batch([ids.slice(lo, hi - lo), pa.array([None if t is None else mux(t) for t in texts.slice(lo, hi - lo).to_pylist()], pa.binary())], ["doc_id", "ts"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, ts binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elementary streams of all documents' transport streams."""
    text_batches(spark)
    return demux(mux_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
