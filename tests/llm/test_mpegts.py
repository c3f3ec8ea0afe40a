import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from treeloom.llm import mpegts as M


def video(p):
    return next(s for s in p["streams"] if s["pid"] == M.VIDEO_PID)


@given(st.binary(max_size=6000))
@settings(max_examples=150, deadline=None)
def test_round_trip(payload):
    ts = M.mux(payload)
    assert len(ts) % M.PACKET == 0
    p = M.parse(ts)
    if not payload:
        assert p["status"] == "empty"
        return
    v = video(p)
    assert p["status"] == "ok" and v["payload"] == payload and v["cc_errors"] == 0 and v["stream_type"] == M.VIDEO_TYPE and v["program"] == 1
    n = -(-len(payload) // M.FRAME)
    assert [x[0] for x in v["pes"]] == [(k + 1) * M.TICKS for k in range(n)] and [x[1] for x in v["pes"]] == [k * M.TICKS for k in range(n)]
    assert [x[2] for x in v["pes"]] == [k % M.GOP == 0 for k in range(n)] and all(x[3] for x in v["pes"])
    a = next(s for s in p["streams"] if s["pid"] == M.AUDIO_PID)
    assert a["payload"][:4] == zlib.crc32(payload[: M.FRAME * M.GOP]).to_bytes(4, "big")


PAYLOAD = bytes(range(256)) * 40
TS = M.mux(PAYLOAD)
ROWS = [TS[i : i + M.PACKET] for i in range(0, len(TS), M.PACKET)]


def pid(r):
    return (r[1] & 31) << 8 | r[2]


def test_lost_packet():
    k = [i for i, r in enumerate(ROWS) if pid(r) == M.VIDEO_PID][9]
    v = video(M.parse(b"".join(ROWS[:k] + ROWS[k + 1 :])))
    assert v["cc_errors"] == 1 and sum(not x[3] for x in v["pes"]) == 1


def test_repeated_packet():
    k = [i for i, r in enumerate(ROWS) if pid(r) == M.VIDEO_PID][9]
    v = video(M.parse(b"".join(ROWS[: k + 1] + ROWS[k:])))
    assert v["cc_errors"] == 0 and v["payload"] == PAYLOAD


def test_damage():
    assert video(M.parse(b"junk" + TS))["payload"] == PAYLOAD and M.parse(b"junk" + TS)["status"] == "damaged"
    bad = bytearray(TS)
    k = [i for i, r in enumerate(ROWS) if pid(r) == M.VIDEO_PID][4]
    bad[k * M.PACKET + 1] |= 0x80
    p = M.parse(bytes(bad))
    assert p["status"] == "damaged" and video(p)["cc_errors"] == 1
    assert M.parse(b"".join(r for r in ROWS if pid(r) != 0))["status"] == "no program"
    broken = b"".join(r if pid(r) else r[:8] + bytes([r[8] ^ 255]) + r[9:] for r in ROWS)
    assert M.parse(broken)["status"] in ("no program", "ok")
    assert M.parse(TS[:100])["status"] == "no packets" and M.parse(b"\0" * 1000)["status"] == "no packets" and M.parse(b"")["status"] == "empty"
    assert video(M.parse(TS[:-10]))["payload"] == PAYLOAD[: len(video(M.parse(TS[:-10]))["payload"])]


@given(st.binary(max_size=800), st.integers(0, 400))
@settings(max_examples=100, deadline=None)
def test_any_bytes(junk, at):
    M.parse(junk)
    M.parse(TS[: at * 7] + junk + TS[at * 7 :])


def test_query_gives_the_texts_back(spark, small, docs):
    got = {r.doc_id: r for r in M.query(spark, small).where(f"pid = {M.VIDEO_PID}").collect()}
    for r in docs.select("doc_id", "text").collect():
        g = got[r.doc_id]
        assert g.digest == hashlib.md5(r.text.encode()).hexdigest() and g.cc_errors == 0 and g.n_bytes == len(r.text.encode()) and sum(x.n_bytes for x in g.pes) == g.n_bytes


def test_odd_rows(odd, empty):
    got = M.demux(M.mux_texts(odd)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.status for r in by[4]] == ["null"] and [r.status for r in by[5]] == ["empty"] and len(by[2]) == 4 and len(by[None]) == 3
    assert next(r for r in by[7] if r.pid == M.VIDEO_PID).n_bytes > 500_000
    assert M.demux(M.mux_texts(empty)).count() == 0


@pytest.mark.parametrize("t", [0, 1, 3600, (1 << 33) - 1])
def test_stamps(t):
    assert M._read_stamp(M._stamp(2, t)) == t


# A second reading of the standard: streams written by hand here, with nothing of the module's writer.


def crc(data):
    """CRC-32/MPEG-2 bit by bit."""
    reg = 0xFFFFFFFF
    for byte in data:
        for bit in range(7, -1, -1):
            top = reg >> 31 ^ byte >> bit & 1
            reg = (reg << 1 ^ (0x04C11DB7 if top else 0)) & 0xFFFFFFFF
    return reg.to_bytes(4, "big")


def section(table, ident, version, now, body, number=0, last=0):
    size = 5 + len(body) + 4
    head = bytes([table, 0xB0 + size // 256, size % 256, ident // 256, ident % 256, 0xC0 + 2 * version + now, number, last])
    return head + body + crc(head + body)


def pat(programs, version=0, now=1, number=0, last=0):
    return section(0, 7, version, now, b"".join(bytes([k // 256, k % 256, 0xE0 + p // 256, p % 256]) for k, p in programs.items()), number, last)


def pmt(number, streams, version=0, now=1, info=b""):
    body = bytes([0xE1, 0x00, 0xF0, len(info)]) + info
    for p, (kind, more) in streams.items():
        body += bytes([kind, 0xE0 + p // 256, p % 256, 0xF0, len(more)]) + more
    return section(2, number, version, now, body)


class Writer:
    def __init__(self, r):
        self.r, self.count, self.rows = r, {}, []

    def put(self, p, payload, begins, field=None, twice=False):
        """One packet: stuffing in the adaptation field fills what the payload leaves."""
        c = self.count.get(p, -1) + (payload is not None)
        self.count[p] = c
        room = 184 - (len(payload) if payload is not None else 0)
        if field is None and room:
            field = b"\x00" if room > 1 else b""
        head = bytes([0x47, (0x40 if begins else 0) + p // 256, p % 256])
        if field is None:
            row = head + bytes([0x10 + c % 16]) + payload
        else:
            af = bytes([room - 1]) + (field + b"\xff" * (room - 1 - len(field)) if room > 1 else b"")
            row = head + bytes([(0x30 if payload is not None else 0x20) + c % 16]) + af + (payload or b"")
        assert len(row) == 188
        self.rows += [row] * (2 if twice else 1)

    def table(self, p, data):
        """Sections behind a pointer, over as many packets as it takes."""
        data = b"\0" + data
        for k in range(0, len(data), 184):
            self.put(p, data[k : k + 184].ljust(184, b"\xff"), k == 0)

    def pes(self, p, data):
        """The packets of one PES packet; their numbers in rows are returned."""
        at, first, own = 0, True, []
        while at < len(data):
            field = b"\x50" + bytes(6) if first else b"\x10" + bytes(6) if self.r.random() < 0.1 else None
            most = 184 - (len(field) + 1 if field else 0)
            take = min(len(data) - at, self.r.choice([most, most, most, max(1, most // 2)]))
            own.append(len(self.rows))
            self.put(p, data[at : at + take], first, field)
            at, first = at + take, False
            if self.r.random() < 0.15:
                self.put(self.r.choice([0x1FFF, 0x1ABC]), bytes(184), False)
            if self.r.random() < 0.05:
                self.put(p, None, False, b"\x00")
        return own


def stamp(prefix, t):
    bits = f"{prefix:04b}{t >> 30:03b}1{t >> 15 & 32767:015b}1{t & 32767:015b}1"
    return int(bits, 2).to_bytes(5, "big")


def made_stream(r):
    """Rows of a stream of two programs, and its PES packets by pid: (pts, dts, body, rows)."""
    w, want = Writer(r), {}
    pids = {1: {0x31: (0x1B, b""), 0x32: (0x0F, b"\x0a\x04eng\0")}, 9: {0x131: (0x24, b"")}}
    for k in range(r.randrange(3, 12)):
        if k % 4 == 0:
            # The association table comes in two sections; the maps are longer than a packet.
            w.table(0, pat({0: 0x10, 1: 0x100}, number=0, last=1) + pat({9: 0x1FE}, number=1, last=1))
            w.table(0x100, pmt(1, pids[1], info=bytes([5, 200]) + bytes(200)))
            w.table(0x1FE, pmt(9, pids[9]))
        for p in (0x31, 0x32, 0x131):
            body, t = r.randbytes(r.randrange(1, 900)), r.randrange(1 << 33)
            if p == 0x32:
                data, got = b"\0\0\1\xbf" + len(body).to_bytes(2, "big") + body, (None, None)
            elif r.random() < 0.5:
                data, got = b"\0\0\1\xe0\0\0\x84\xc0\x0c" + stamp(3, t) + stamp(1, t // 2) + b"\xff\xff" + body, (t, t // 2)
            else:
                data, got = b"\0\0\1\xe0" + (8 + len(body)).to_bytes(2, "big") + b"\x84\x80\x05" + stamp(2, t) + body, (t, t)
            want.setdefault(p, []).append((*got, body, w.pes(p, data)))
    return w.rows, want


def test_streams_written_by_hand():
    r = random.Random(5)
    for _ in range(60):
        rows, want = made_stream(r)
        for data in (b"".join(rows), b"".join(b"\x12\x34\x56\x78" + x for x in rows), b"".join(x + bytes(16) for x in rows)):
            p = M.parse(data)
            assert p["n_packets"] == len(rows) and p["status"] == ("ok" if len(data) == 188 * len(rows) else "damaged")
            assert [(s["program"], s["pid"], s["stream_type"]) for s in p["streams"]] == [(1, 0x31, 0x1B), (1, 0x32, 0x0F), (9, 0x131, 0x24)]
            for s in p["streams"]:
                assert s["cc_errors"] == 0 and s["payload"] == b"".join(x[2] for x in want[s["pid"]])
                assert [(x[0], x[1], x[2], x[3], x[5]) for x in s["pes"]] == [(a, b, True, True, len(body)) for a, b, body, _ in want[s["pid"]]]


def test_any_lost_packet_leaves_its_pes_incomplete():
    """Whichever packet of a stream goes, and whatever comes after it, just the PES packet it belonged to is incomplete."""
    r = random.Random(6)
    for _ in range(12):
        rows, want = made_stream(r)
        for p, made in want.items():
            for k, x in enumerate(made):
                gone = r.choice(x[3][1:] or x[3])
                streams = {s["pid"]: s for s in M.parse(b"".join(rows[:gone] + rows[gone + 1 :]))["streams"]}
                marks = [y[3] for y in streams[p]["pes"]]
                if gone != x[3][0]:
                    last = k == len(made) - 1 and gone == x[3][-1] and not any(pid(y) == p for y in rows[gone + 1 :])
                    assert sum(marks) == len(made) - 1 + (last and marks[-1]) and (last or not marks[k])
                    assert last or streams[p]["cc_errors"] == 1
                assert all(y[3] for q in want if q != p for y in streams[q]["pes"])


def test_lost_packet_before_one_without_payload():
    w = Writer(random.Random(1))
    w.table(0, pat({1: 0x100}))
    w.table(0x100, pmt(1, {0x31: (0x1B, b"")}))
    head = b"\0\0\1\xe0\0\0\x80\0\0"
    w.put(0x31, head + bytes(175), True)
    w.put(0x31, b"a" * 184, False)
    w.put(0x31, None, False, b"\0")
    w.put(0x31, b"b" * 184, False)
    w.put(0x31, head + bytes(175), True)
    s = M.parse(b"".join(w.rows[:3] + w.rows[4:]))["streams"][0]
    assert s["cc_errors"] == 1 and [x[3] for x in s["pes"]] == [False, True]


def test_junk_that_looks_like_sync():
    for junk in (b"G", b"GGGG", b"G" * 100, b"G" + bytes(187), b"G" * 188 + b"x", b"G" + bytes(400)):
        p = M.parse(junk + TS)
        assert video(p)["payload"] == PAYLOAD and video(p)["cc_errors"] == 0 and p["status"] == ("damaged" if len(junk) != 188 else "ok"), junk
    p = M.parse(TS + b"G" * 50)
    assert video(p)["payload"] == PAYLOAD


@pytest.mark.parametrize("change", [lambda t, k: t[:k] + b"!" + t[k:], lambda t, k: t[:k] + t[k + 1 :], lambda t, k: t[:k] + b"junk" * 300 + t[k:], lambda t, k: t[: k - 70] + t[k:]])
def test_lock_is_found_again(change):
    """A byte too many or too few, junk or a gap in mid-stream: all but the packets beside it are recovered."""
    for at in (20 * 188 + 94, 31 * 188, 40 * 188 + 187):
        v = video(M.parse(change(TS, at)))
        assert v["payload"][:2000] == PAYLOAD[:2000] and v["payload"][-2000:] == PAYLOAD[-2000:]
        assert len(PAYLOAD) - 600 <= len(v["payload"]) <= len(PAYLOAD) and sum(not x[3] for x in v["pes"]) <= 2
        whole = [PAYLOAD[k * M.FRAME : (k + 1) * M.FRAME] for k in range(-(-len(PAYLOAD) // M.FRAME))]
        for x in v["pes"]:
            if x[3]:
                assert v["payload"][x[4] : x[4] + x[5]] == whole[x[1] // M.TICKS]


def test_lost_sync_byte_keeps_its_place():
    k = [i for i, x in enumerate(ROWS) if pid(x) == M.VIDEO_PID][7]
    p = M.parse(b"".join(ROWS[:k]) + b"\0" + ROWS[k][1:] + b"".join(ROWS[k + 1 :]))
    assert p["n_packets"] == len(ROWS) and video(p)["cc_errors"] == 1


def test_versions_of_tables():
    """A new version holds from its place on; one that is announced only (current/next) doesn't."""
    w = Writer(random.Random(1))
    pes = lambda c: b"\0\0\1\xe0\0\0\x80\0\0" + c * 100
    w.table(0, pat({1: 0x100}))
    w.table(0x100, pmt(1, {0x31: (0x1B, b""), 0x40: (0x0F, b"")}))
    w.pes(0x31, pes(b"a"))
    w.pes(0x40, pes(b"s"))
    w.table(0x100, pmt(1, {0x33: (0x1B, b"")}, version=1, now=0))
    w.pes(0x31, pes(b"b"))
    w.pes(0x33, pes(b"x"))
    w.table(0x100, pmt(1, {0x33: (0x1B, b""), 0x40: (0x0F, b"")}, version=1))
    w.pes(0x31, pes(b"y"))
    w.pes(0x33, pes(b"c"))
    w.pes(0x40, pes(b"t"))
    got = {(s["pid"], s["payload"]) for s in M.parse(b"".join(w.rows))["streams"]}
    assert got == {(0x31, b"a" * 100 + b"b" * 100), (0x33, b"c" * 100), (0x40, b"s" * 100 + b"t" * 100)}


def test_long_stream():
    payload = random.Random(2).randbytes(3_000_000)
    ts = M.mux(payload)
    assert video(M.parse(ts[:900_000] + b"?" + ts[900_000:]))["payload"][-1_000_000:] == payload[-1_000_000:]
