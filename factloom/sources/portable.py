"""Portable executables and their metadata (S12-S14, S16 in part): a reader of bytes, without loading any code.

The layout is the public one of ECMA-335: a metadata root with streams, a table stream with row counts, and rows whose
index sizes follow from the counts. Only what methods need is decoded: types, methods, parameters and method bodies. A
file that is broken gives a diagnostic row and never an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Columns of the metadata tables up to MethodDef, by table number: 2 and 4 are bytes, S, G, B heap indexes, T a table
#: index, C a coded index. ECMA-335 II.22.
COLUMNS: dict[int, list] = {
    0x00: [2, "S", "G", "G", "G"],
    0x01: [("C", "ResolutionScope"), "S", "S"],
    0x02: [4, "S", "S", ("C", "TypeDefOrRef"), ("T", 0x04), ("T", 0x06)],
    0x03: [("T", 0x04)],
    0x04: [2, "S", "B"],
    0x05: [("T", 0x06)],
    0x06: [4, 2, 2, "S", "B", ("T", 0x08)],
    0x07: [("T", 0x08)],
    0x08: [2, 2, "S"],
    0x09: [("T", 0x02), ("C", "TypeDefOrRef")],
    0x0A: [("C", "MemberRefParent"), "S", "B"],
}
#: Tables that a coded index can point to, and its tag bits. ECMA-335 II.24.2.6.
CODED = {
    "ResolutionScope": ((0x00, 0x1A, 0x23, 0x01), 2),
    "TypeDefOrRef": ((0x02, 0x01, 0x1B), 2),
    "MemberRefParent": ((0x02, 0x01, 0x1A, 0x06, 0x1B), 3),
}
MOST_TARGETS = 4096
SCHEMA = "path string, kind string, token int, namespace string, type string, name string, parameters int, body_offset int, body_size int, diagnostic string"


class Image:
    """A managed executable: sections, heaps and tables."""

    def __init__(self, data: bytes):
        self.data = data
        if data[:2] != b"MZ":
            raise ValueError("no executable")
        pe = self.u4(0x3C)
        if data[pe : pe + 4] != b"PE\0\0":
            raise ValueError("no executable")
        sections, optional = self.u2(pe + 6), self.u2(pe + 20)
        wide = self.u2(pe + 24) == 0x20B
        directory = pe + 24 + (112 if wide else 96) + 14 * 8
        first = pe + 24 + optional
        self.sections = [struct.unpack_from("<IIII", data, first + 40 * i + 8) for i in range(sections)]
        header = self.offset(self.u4(directory))
        root = self.offset(self.u4(header + 8))
        if data[root : root + 4] != b"BSJB":
            raise ValueError("no metadata")
        at = root + 16 + self.u4(root + 12)
        self.streams = {}
        count, at = self.u2(at + 2), at + 4
        for _ in range(count):
            offset, size = struct.unpack_from("<II", data, at)
            end = data.index(b"\0", at + 8)
            self.streams[data[at + 8 : end].decode()] = (root + offset, size)
            at += 8 + (end - at - 8 + 4) // 4 * 4  # the name, its end and filling
        self.read_tables()

    def u2(self, at: int) -> int:
        return struct.unpack_from("<H", self.data, at)[0]

    def u4(self, at: int) -> int:
        return struct.unpack_from("<I", self.data, at)[0]

    def offset(self, address: int) -> int:
        for size, start, raw, place in self.sections:
            if start <= address < start + max(size, raw):
                return address - start + place
        raise ValueError("an address outside all sections")

    def text(self, index: int) -> str:
        start = self.streams["#Strings"][0] + index
        return self.data[start : self.data.index(b"\0", start)].decode("utf-8", "replace")

    def read_tables(self) -> None:
        at = self.streams.get("#~", self.streams.get("#-", (None,)))[0]
        if at is None:
            raise ValueError("no tables")
        heaps, valid = self.data[at + 6], struct.unpack_from("<Q", self.data, at + 8)[0]
        counts, at = {}, at + 24
        for i in range(64):
            if valid >> i & 1:
                counts[i], at = self.u4(at), at + 4
        self.counts, self.tables = counts, {}
        size = {"S": 4 if heaps & 1 else 2, "G": 4 if heaps & 2 else 2, "B": 4 if heaps & 4 else 2}

        def width(column) -> int:
            if isinstance(column, int):
                return column
            if isinstance(column, str):
                return size[column]
            if column[0] == "T":
                return 4 if counts.get(column[1], 0) >= 1 << 16 else 2
            tables, bits = CODED[column[1]]
            return 4 if max(counts.get(t, 0) for t in tables) >= 1 << (16 - bits) else 2

        for i in sorted(counts):
            if i not in COLUMNS:
                return  # later tables aren't needed
            form = "<" + "".join({2: "H", 4: "I"}[width(c)] for c in COLUMNS[i])
            step = struct.calcsize(form)
            self.tables[i] = [struct.unpack_from(form, self.data, at + k * step) for k in range(counts[i])]
            at += step * counts[i]

    def compressed(self, at: int) -> tuple[int, int]:
        b = self.data[at]
        if b < 0x80:
            return b, at + 1
        if b < 0xC0:
            return (b & 0x3F) << 8 | self.data[at + 1], at + 2
        return (b & 0x1F) << 24 | self.data[at + 1] << 16 | self.data[at + 2] << 8 | self.data[at + 3], at + 4

    def parameter_count(self, blob: int) -> int:
        """The number of parameters in a method's signature."""
        _, at = self.compressed(self.streams["#Blob"][0] + blob)
        generic, at = self.data[at] & 0x10, at + 1
        if generic:
            _, at = self.compressed(at)
        return self.compressed(at)[0]

    def body(self, address: int) -> tuple[int, int]:
        """The offset and size of a method's code."""
        if not address:
            return 0, 0
        at = self.offset(address)
        if self.data[at] & 3 == 2:
            return at + 1, self.data[at] >> 2
        return at + 4 * (self.u2(at) >> 12), self.u4(at + 4)

    def members(self) -> Iterator[tuple]:
        """(kind, token, namespace, type, name, parameters, body offset, body size) of all methods."""
        types, methods = self.tables.get(0x02, []), self.tables.get(0x06, [])
        for i, row in enumerate(types):
            stop = types[i + 1][5] if i + 1 < len(types) else len(methods) + 1
            for k in range(row[5], stop):
                address, _, _, name, signature, _ = methods[k - 1]
                called = self.text(name)
                yield "constructor" if called in (".ctor", ".cctor") else "method", 0x06000000 | k, self.text(row[2]), self.text(row[1]), called, self.parameter_count(signature), *self.body(address)


def members(files: DataFrame) -> DataFrame:
    """Methods of executables (path, content); a broken file is one row with a diagnostic."""
    columns = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows += [(path, *m, None) for m in Image(bytes(content or b"")).members()]
                except (ValueError, IndexError, KeyError, struct.error) as error:
                    rows.append((path, "diagnostic", None, None, None, None, None, None, None, str(error)))
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({c: "Int32" for c in ("token", "parameters", "body_offset", "body_size")})

    return files.select("path", "content").mapInPandas(run, SCHEMA)


#: One-byte opcodes with operands, by operand size in bytes; others have none. ECMA-335 III.1.2.
ONE_BYTE = {0x0E: 1, 0x0F: 1, 0x10: 1, 0x11: 1, 0x12: 1, 0x13: 1, 0x1F: 1, 0x20: 4, 0x21: 8, 0x22: 4, 0x23: 8, 0x27: 4, 0x28: 4, 0x29: 4}
ONE_BYTE |= dict.fromkeys(range(0x2B, 0x38), 1) | dict.fromkeys(range(0x38, 0x45), 4) | dict.fromkeys((0x6F, 0x70, 0x71, 0x72, 0x73, 0x74, 0x75, 0x79), 4)
ONE_BYTE |= dict.fromkeys((*range(0x7B, 0x82), 0x8C, 0x8D, 0x8F, 0xA3, 0xA4, 0xA5, 0xC2, 0xC6, 0xD0, 0xDD), 4) | {0xDE: 1}
SWITCH = 0x45
TWO_BYTE = {0x06: 4, 0x07: 4, 0x09: 2, 0x0A: 2, 0x0B: 2, 0x0C: 2, 0x0D: 2, 0x0E: 2, 0x12: 1, 0x15: 4, 0x16: 4, 0x1C: 4, 0x19: 1}
UNUSED = frozenset((*range(0x24, 0x25), 0x77, 0x78, *range(0xA6, 0xB3), *range(0xBB, 0xC2), 0xC4, 0xC5, *range(0xC7, 0xD0), *range(0xE1, 0xFE), 0xFF))


def instructions(code: bytes) -> list[tuple[int, int, int, int | list[int] | None]]:
    """(offset, next offset, opcode, operand); an unknown opcode or a broken operand ends the body."""
    out, at = [], 0
    while at < len(code):
        start, op, at = at, code[at], at + 1
        if op == 0xFE:
            if at >= len(code) or code[at] > 0x1E:
                break
            op, size, at = 0xFE00 | code[at], TWO_BYTE.get(code[at], 0), at + 1
        elif op in UNUSED:
            break
        elif op == SWITCH:
            if at + 4 > len(code):
                break
            count = struct.unpack_from("<i", code, at)[0]
            if not 0 <= count <= MOST_TARGETS or at + 4 + 4 * count > len(code):
                break
            after = at + 4 + 4 * count
            out.append((start, after, op, [after + x for x in struct.unpack_from(f"<{count}i", code, at + 4)]))
            at = after
            continue
        else:
            size = ONE_BYTE.get(op, 0)
        if at + size > len(code):
            break
        operand = int.from_bytes(code[at : at + size], "little", signed=size in (1, 4) and (0x2B <= op < 0x45 or op in (0xDD, 0xDE))) if size else None
        at += size
        out.append((start, at, op, operand))
    return out


def successors(body: list[tuple[int, int, int, int | list[int] | None]]) -> dict[int, list[int]]:
    """The offsets that can follow each instruction; returns and throws have none."""
    out = {}
    for at, after, op, operand in body:
        if op in (0x2A, 0x7A, 0xDC, 0xFE1A):
            out[at] = []
        elif op == SWITCH:
            out[at] = [*operand, after]
        elif op in (0x2B, 0x38, 0xDD, 0xDE):
            out[at] = [after + operand]
        elif 0x2C <= op <= 0x44:
            out[at] = [after + operand, after]
        else:
            out[at] = [after]
    return out


def call_tokens(body: list[tuple[int, int, int, int | list[int] | None]]) -> list[tuple[int, str, int]]:
    """(offset, kind, token) of calls, object creations and function pointers."""
    kinds = {0x28: "call", 0x6F: "callvirt", 0x73: "newobj", 0xFE06: "ldftn", 0xFE07: "ldvirtftn"}
    return [(at, kinds[op], operand) for at, _, op, operand in body if op in kinds]
