"""The executable reader on bodies and on broken files."""

import struct

from factloom.sources import portable


def test_switch_operands():
    assert len(portable.instructions(b"\x45" + struct.pack("<i", 0))) == 1
    for broken in (b"\x45" + struct.pack("<i", -1), b"\x45" + struct.pack("<i", 3) + b"\0" * 4, b"\x45" + struct.pack("<i", 5000) + b"\0" * 20000, b"\x45\0"):
        assert portable.instructions(broken) == []


def test_flow_and_calls():
    code = b"\x02\x2c\x06\x28" + struct.pack("<I", 0x0A000001) + b"\x2a\x2a"
    body = portable.instructions(code)
    assert [(at, op) for at, _, op, _ in body] == [(0, 0x02), (1, 0x2C), (3, 0x28), (8, 0x2A), (9, 0x2A)]
    assert portable.successors(body) == {0: [1], 1: [9, 3], 3: [8], 8: [], 9: []}
    assert portable.call_tokens(body) == [(3, "call", 0x0A000001)]
    assert portable.instructions(b"\x00\xff\x00") == [(0, 1, 0, None)]


def image() -> bytes:
    """The least executable with one type and two methods."""
    strings = b"\0<Module>\0Run\0.ctor\0My\0App\0"
    blob = b"\0\x04\x00\x02\x01\x08\x08"
    at = lambda name: strings.index(name + b"\0")
    valid = 1 << 0 | 1 << 2 | 1 << 6
    tables = struct.pack("<IBBBBQQ", 0, 2, 0, 0, 1, valid, 0) + struct.pack("<III", 1, 2, 2)
    tables += struct.pack("<HHHHH", 0, 0, 0, 0, 0)
    tables += struct.pack("<IHHHHH", 0, at(b"<Module>"), 0, 0, 1, 1) + struct.pack("<IHHHHH", 0, at(b"My"), at(b"App"), 0, 1, 1)
    tables += struct.pack("<IHHHHH", 0x2000 + 400, 0, 0, at(b"Run"), 1, 1) + struct.pack("<IHHHHH", 0, 0, 0, at(b".ctor"), 1, 1)
    streams, offset, heads = [(b"#~", tables), (b"#Strings", strings), (b"#Blob", blob)], 0, b""
    base = 16 + 4 + 4 + sum(8 + (len(n) + 4) // 4 * 4 for n, _ in streams)
    for name, data in streams:
        heads += struct.pack("<II", base + offset, len(data)) + name.ljust((len(name) + 4) // 4 * 4, b"\0")
        offset += len(data)
    root = b"BSJB" + struct.pack("<HHII", 1, 1, 0, 4) + b"v4\0\0" + struct.pack("<HH", 0, 3) + heads + b"".join(d for _, d in streams)
    section = struct.pack("<IHHII", 72, 2, 5, 0x2000 + 72, len(root)).ljust(72, b"\0") + root
    section = section.ljust(400, b"\0") + b"\x0a\x00\x2a"
    pe = b"PE\0\0" + struct.pack("<HHIIIHH", 0x14C, 1, 0, 0, 0, 224, 0)
    optional = (struct.pack("<H", 0x10B).ljust(92, b"\0") + struct.pack("<I", 16) + b"\0" * 112 + struct.pack("<II", 0x2000, 72)).ljust(224, b"\0")
    head = b"MZ".ljust(0x3C, b"\0") + struct.pack("<I", 64)
    table = b".text\0\0\0" + struct.pack("<IIII", len(section), 0x2000, len(section), 512) + b"\0" * 16
    return (head + pe + optional + table).ljust(512, b"\0") + section


def test_members(spark):
    from factloom.sources.files import is_managed

    data = image()
    assert is_managed(data)
    rows = [("a.dll", bytearray(data)), ("b.dll", bytearray(data[:200])), ("c.txt", bytearray(b"x"))]
    got = portable.members(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert {(r.path, r.kind, r.namespace, r.type, r["name"], r.parameters, r.body_size) for r in got if r.path == "a.dll"} == {
        ("a.dll", "method", "App", "My", "Run", 2, 2), ("a.dll", "constructor", "App", "My", ".ctor", 2, 0)}
    assert {r.path for r in got if r.kind == "diagnostic"} == {"b.dll", "c.txt"}
    run = next(r for r in got if r["name"] == "Run")
    assert [op for _, _, op, _ in portable.instructions(data[run.body_offset : run.body_offset + run.body_size])] == [0x00, 0x2A]
