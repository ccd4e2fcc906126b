"""Readers of binary tables: R data frames, numpy arrays and MATLAB matrices, one file a row until they are parsed in tasks."""

from __future__ import annotations

import ast
import bz2
import gzip
import lzma
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


class RData:
    """Parses R's binary serialisation (XDR, versions 2 and 3), as far as data frames need it."""

    def __init__(self, raw: bytes):
        if raw[:2] == b"\x1f\x8b":
            raw = gzip.decompress(raw)
        elif raw[:3] == b"BZh":
            raw = bz2.decompress(raw)
        elif raw[:6] == b"\xfd7zXZ\x00":
            raw = lzma.decompress(raw)
        if raw[:5] not in (b"RDX2\n", b"RDX3\n") or raw[5:7] != b"X\n":
            raise ValueError("not a binary R data file")
        self.raw, self.at, self.refs = raw, 7, []
        version = self._int()
        self._int(), self._int()
        if version == 3:
            self.at += self._int()

    def _int(self) -> int:
        self.at += 4
        return struct.unpack_from(">i", self.raw, self.at - 4)[0]

    def _array(self, kind: str) -> np.ndarray:
        n = self._int()
        if n == -1:
            n = (self._int() << 32) + self._int()
        out = np.frombuffer(self.raw, kind, n, self.at)
        self.at += out.nbytes
        return out

    def item(self):
        flags = self._int()
        kind, attributes, tagged = flags & 255, flags & 512, flags & 1024
        if kind in (254, 253, 242, 251, 252, 241):  # nil and the standard environments
            return None
        if kind == 255:  # a symbol seen before
            return self.refs[(flags >> 8 or self._int()) - 1]
        if kind == 1:  # symbol
            name = self.item()
            self.refs.append(name)
            return name
        if kind == 2:  # pairlist
            out = {}
            while kind == 2:
                attr = self.item() if attributes else None
                del attr
                tag = self.item() if tagged else len(out)
                out[tag] = self.item()
                flags = self._int()
                kind, attributes, tagged = flags & 255, flags & 512, flags & 1024
            return out
        if kind == 9:  # one string
            n = self._int()
            if n == -1:
                return None
            self.at += n
            text = self.raw[self.at - n : self.at]
            return text.decode("latin-1" if flags >> 12 & 4 else "utf-8", "replace")
        if kind in (10, 13):
            value = self._array(">i4")
            value = np.where(value == -(2**31), np.nan, value) if (value == -(2**31)).any() else value.astype(np.int64)
        elif kind == 14:
            value = self._array(">f8").astype(float)
        elif kind in (16, 19, 20):
            value = [self.item() for _ in range(self._int())]
        elif kind == 238:  # an alternative representation: a compact sequence or a wrapper
            info, state, attr = self.item(), self.item(), self.item()
            name = next(iter(info.values()))
            value = np.arange(int(state[0])) * int(state[2]) + int(state[1]) if "compact" in name else state[0] if isinstance(state, list) else next(iter(state.values()))
            return (value, attr) if attr else value
        else:
            raise ValueError(f"R type {kind} isn't read")
        return (value, self.item()) if attributes else value

    def frames(self) -> dict[str, pd.DataFrame]:
        """The data frames of the file by name."""
        out = {}
        for name, value in self.item().items():
            if isinstance(value, tuple) and "names" in value[1]:
                out[name] = pd.DataFrame({c: _column(v) for c, v in zip(_plain(value[1]["names"]), value[0], strict=True)})
        return out


def _plain(x):
    return x[0] if isinstance(x, tuple) else x


def _column(x):
    if isinstance(x, tuple):
        value, attr = x
        if "levels" in attr:
            levels = _plain(attr["levels"])
            return [None if k != k else levels[int(k) - 1] for k in value]
        return value
    return x


def numpy_array(raw: bytes) -> np.ndarray:
    """The array of a .npy file; object arrays aren't read."""
    if raw[:6] != b"\x93NUMPY":
        raise ValueError("not a .npy file")
    size, at = (struct.unpack_from("<H", raw, 8)[0], 10) if raw[6] == 1 else (struct.unpack_from("<I", raw, 8)[0], 12)
    head = ast.literal_eval(raw[at : at + size].decode("latin-1"))
    if "O" in str(head["descr"]):
        raise ValueError("object arrays aren't read")
    a = np.frombuffer(raw, np.dtype(head["descr"]), offset=at + size)
    return a.reshape(head["shape"], order="F" if head["fortran_order"] else "C")


_MAT = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}


def matlab_matrices(raw: bytes) -> dict[str, np.ndarray]:
    """The numeric matrices of a MATLAB file of version 5 by name."""
    order = "<" if raw[126:128] == b"IM" else ">"

    def element(buf: bytes, at: int):
        word = struct.unpack_from(order + "I", buf, at)[0]
        if word >> 16:
            return word & 0xFFFF, buf[at + 4 : at + 4 + (word >> 16)], at + 8
        n = struct.unpack_from(order + "I", buf, at + 4)[0]
        return word, buf[at + 8 : at + 8 + n], at + 8 + n + (0 if word == 15 else -n % 8)

    out, at = {}, 128
    while at < len(raw):
        kind, body, at = element(raw, at)
        if kind == 15:
            kind, body, _ = element(zlib.decompress(body), 0)
        if kind != 14:
            continue
        k, parts = 0, []
        while k < len(body) and len(parts) < 4:
            t, b, k = element(body, k)
            parts.append((t, b))
        if len(parts) == 4 and parts[3][0] in _MAT:
            shape = np.frombuffer(parts[1][1], order + "i4")
            data = np.frombuffer(parts[3][1], order + _MAT[parts[3][0]]).astype(float)
            out[parts[2][1].decode()] = data.reshape(shape, order="F")
    return out


def r_frames(spark: SparkSession, path: str, schema: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Rows of all data frames of .rda files, their columns aligned to a schema: dots in names are underscores, missing columns null."""
    from pyspark.sql.types import StructType

    want = StructType.fromDDL(schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for raw in f["content"]:
                for own in RData(bytes(raw)).frames().values():
                    own.columns = [c.replace(".", "_") for c in own.columns]
                    own = own.drop(columns=[c for c in drop if c in own])
                    yield pd.DataFrame({c.name: _typed(own[c.name] if c.name in own else pd.Series([None] * len(own)), c.dataType.typeName()) for c in want.fields})

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, want)


def _typed(x: pd.Series, kind: str):
    if kind == "string":
        return [None if v is None or v != v else str(int(v)) if isinstance(v, float) and v == int(v) else str(v) for v in x]
    return pd.to_numeric(x, errors="coerce").astype("Int64" if kind in ("integer", "long") else float)


def matrix_rows(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """(file, i, vec): the rows of matrices in .npy or .mat files (of the variable called name), further dimensions laid flat."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for file, raw in zip(f["path"], f["content"], strict=True):
                raw = bytes(raw)
                a = numpy_array(raw) if raw[:6] == b"\x93NUMPY" else (m := matlab_matrices(raw))[name or next(iter(m))]
                a = np.asarray(a, float).reshape(len(a), -1)
                for k in range(0, len(a), 4096):
                    yield pd.DataFrame({"file": file, "i": np.arange(k, k + len(a[k : k + 4096])), "vec": list(a[k : k + 4096])})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, i int, vec array<double>")


class Packed:
    """Parses MessagePack, as far as lists, maps, strings and numbers go."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def _number(self, kind: str):
        size = struct.calcsize(kind)
        self.at += size
        return struct.unpack_from(">" + kind, self.raw, self.at - size)[0]

    def _text(self, n: int) -> str:
        self.at += n
        return self.raw[self.at - n : self.at].decode()

    def _map(self, n: int) -> dict:
        return {self.item(): self.item() for _ in range(n)}

    def item(self):
        kind = self._number("B")
        if kind < 0x80 or kind >= 0xE0:
            return kind if kind < 0x80 else kind - 256
        if kind < 0x90:
            return self._map(kind & 15)
        if kind < 0xA0:
            return [self.item() for _ in range(kind & 15)]
        if kind < 0xC0:
            return self._text(kind & 31)
        if kind in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[kind]
        if 0xC4 <= kind <= 0xC6 or 0xD9 <= kind <= 0xDB:
            return self._text(self._number("BHI"[kind - (0xC4 if kind < 0xD9 else 0xD9)]))
        if 0xCA <= kind <= 0xD3:
            return self._number("fdBHIQbhiq"[kind - 0xCA])
        if kind in (0xDC, 0xDD):
            return [self.item() for _ in range(self._number("HI"[kind - 0xDC]))]
        if kind in (0xDE, 0xDF):
            return self._map(self._number("HI"[kind - 0xDE]))
        raise ValueError(f"no MessagePack that is read here: {kind:#x}")


def frequency_lists(spark: SparkSession, path: str) -> DataFrame:
    """(list, word, frequency): binned lists of word frequencies, one file each, named for its list (large_en.msgpack.gz: en).

    A file is a header and then bins of words, gzipped MessagePack; the words of bin k have a
    frequency of 10 to the -k/100. Other headers are an error. A file is parsed by one task
    (lists have under a million words); an empty bin has no rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for file, raw in zip(f["path"], f["content"], strict=True):
                raw = bytes(raw)
                head, *bins = Packed(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).item()
                if head != {"format": "cB", "version": 1}:
                    raise ValueError(f"{file}: no list of binned frequencies")
                name = file.rsplit("/", 1)[-1].split(".")[0].split("_")[-1]
                for k, words in enumerate(bins):
                    if words:
                        yield pd.DataFrame({"list": name, "word": words, "frequency": 10 ** (-k / 100)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "list string, word string, frequency double")
