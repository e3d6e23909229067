"""BAM files: reads in splits of compressed blocks, sizes from the header, and a writer of one file for each partition.

A BAM file is a row of BGZF blocks of at most 64 KB each, and records run on over the blocks. A split is a range of the file's
bytes: it takes the records that begin in blocks that begin in it. So each task finds the first block in its range by the
blocks' own lengths, and the first record in there as the first place from which a chain of well-formed records follows; the
header, and where the records begin, is read once when the splits are planned. Files are opened by pyarrow, so paths may be URIs.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: How a BGZF block begins, and the empty block that ends a file.
MAGIC = b"\x1f\x8b\x08\x04"
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
SCHEMA = "flag int, c1 string, p1 bigint, mapq int, c2 string, p2 bigint, filters int"
SPLIT_BYTES = 64 << 20
#: Smaller splits than SPLIT_BYTES are asked for to spread small files; they grow rather than become more than about so many.
SPLITS = 512
#: Records that must follow one another for a place to be taken as a record's beginning, unless the file ends before.
CHAIN = 20
BATCH = 50_000
_FIXED = "<iiiBBHHHiii"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def bam_files(path: str) -> list[tuple[str, int]]:
    """The BAM file at a path, or those in a folder, each with its size."""
    system, at = _open(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    info = system.get_file_info(at)
    if info.type == fs.FileType.Directory:
        found = [f for f in system.get_file_info(fs.FileSelector(at)) if f.path.endswith(".bam")]
        return sorted((prefix + f.path, f.size) for f in found)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return [(path, info.size)]


def is_folder_of_bam(path: str) -> bool:
    """Whether a path that this machine can list is a folder that holds BAM files."""
    try:
        return bool(bam_files(path)) and _open(path)[0].get_file_info(_open(path)[1]).type == fs.FileType.Directory
    except (OSError, ValueError, pa.ArrowInvalid):
        return False


def _block_size(head: bytes) -> int | None:
    """The whole size of the block that begins with head, None if none does."""
    if len(head) < 18 or head[:4] != MAGIC:
        return None
    extra, at = head[12 : 12 + int.from_bytes(head[10:12], "little")], 0
    while at + 4 <= len(extra):
        size = int.from_bytes(extra[at + 2 : at + 4], "little")
        if extra[at : at + 2] == b"BC" and size == 2:
            return int.from_bytes(extra[at + 4 : at + 6], "little") + 1
        at += 4 + size
    return None


class _Blocks:
    """The blocks of a file from a place on: (where it begins, its bytes unpacked)."""

    def __init__(self, path: str):
        system, at = _open(path)
        self.file = system.open_input_file(at)
        self.size = self.file.size()

    def _at(self, place: int, n: int) -> bytes:
        self.file.seek(place)
        return self.file.read(n)

    def first_from(self, place: int) -> int:
        """The first block's beginning at place or after it: one whose length leads to another block or to the end."""
        while place < self.size:
            window = self._at(place, 1 << 17)
            at = window.find(MAGIC)
            while at >= 0:
                size = _block_size(window[at : at + 65_600])
                if size:
                    after = place + at + size
                    if after == self.size or after < self.size and _block_size(self._at(after, 65_600)):
                        return place + at
                at = window.find(MAGIC, at + 1)
            place += max(1, len(window) - 3)
        return self.size

    def read(self, place: int) -> Iterator[tuple[int, bytes]]:
        while place < self.size:
            data = self._at(place, 1 << 16)
            size = _block_size(data)
            if not size or place + size > self.size:
                raise ValueError(f"no whole BGZF block at byte {place}")
            if size > len(data):
                data = self._at(place, size)
            extra = 12 + int.from_bytes(data[10:12], "little")
            out = zlib.decompress(data[extra : size - 8], -15)
            if zlib.crc32(out) != int.from_bytes(data[size - 8 : size - 4], "little"):
                raise ValueError(f"a damaged BGZF block at byte {place}")
            yield place, out
            place += size


@dataclass
class Header:
    chroms: list[tuple[str, int]]
    #: The block in which the records begin, and the place in there.
    block: int
    inside: int


def read_header(path: str) -> Header:
    """References of a BAM file in their order, and where its records begin."""
    data, starts = bytearray(), []
    blocks = _Blocks(path).read(0)

    def need(n: int) -> None:
        while len(data) < n:
            place, more = next(blocks, (None, None))
            if place is None:
                raise ValueError("the BAM header is cut short")
            starts.append((len(data), place, len(more)))
            data.extend(more)

    need(12)
    if data[:4] != b"BAM\x01":
        raise ValueError("no BAM file")
    at = 8 + int.from_bytes(data[4:8], "little")
    need(at + 4)
    n, at, chroms = int.from_bytes(data[at : at + 4], "little"), at + 4, []
    for _ in range(n):
        need(at + 4)
        length = int.from_bytes(data[at : at + 4], "little")
        need(at + 8 + length)
        chroms.append((data[at + 4 : at + 3 + length].decode(), int.from_bytes(data[at + 4 + length : at + 8 + length], "little")))
        at += 8 + length
    begin, place, size = [s for s in starts if s[0] <= at][-1]
    if at == begin + size:  # the records begin with the next block
        return Header(chroms, place, at - begin)
    return Header(chroms, place, at - begin)


def _plausible(data: bytes, at: int, chroms: list[tuple[str, int]]) -> int:
    """The size of the record that may begin at a place, length and all; 0 if none can, -1 if too little is there to tell."""
    if at + 36 > len(data):
        return -1
    size, ref, pos, l_name, _, _, n_cigar, flag, l_seq, next_ref, next_pos = struct.unpack_from(_FIXED, data, at)
    fits = lambda r, p: -1 <= r < len(chroms) and -1 <= p and (r < 0 or p <= chroms[r][1])
    if not (fits(ref, pos) and fits(next_ref, next_pos) and l_name >= 1 and l_seq >= 0 and flag < 1 << 12 and size >= 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq):
        return 0
    name = data[at + 36 : at + 36 + l_name]
    if len(name) < l_name:
        return -1
    return size + 4 if name[-1] == 0 and all(33 <= c <= 126 for c in name[:-1]) else 0


def _filter_tag(data: bytes, at: int, end: int, tag: bytes) -> int:
    """The whole number that a tag of a record holds, 0 without it; at and end bound the record's tags."""
    sizes = {65: 1, 99: 1, 67: 1, 115: 2, 83: 2, 105: 4, 73: 4, 102: 4}  # A c C s S i I f
    while at + 3 <= end:
        name, kind = data[at : at + 2], data[at + 2]
        at += 3
        if kind in sizes:
            if name == tag and kind not in (65, 102):
                return int.from_bytes(data[at : at + sizes[kind]], "little", signed=kind in (99, 115, 105))
            at += sizes[kind]
        elif kind in (90, 72):  # Z H
            at = data.index(0, at) + 1
        elif kind == 66:  # B
            at += 5 + sizes[data[at]] * int.from_bytes(data[at + 1 : at + 5], "little")
        else:
            raise ValueError(f"an unknown kind of tag: {chr(kind)}")
    return 0


@dataclass
class Split(InputPartition):
    path: str
    low: int
    high: int
    #: Of a file's first split: where in its first block the records begin; else -1.
    inside: int


class BamReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.tag = options["path"], options.get("filtertag", "").encode()
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        self.headers: dict[str, Header] = {}

    def partitions(self) -> list[InputPartition]:
        out, files = [], bam_files(self.path)
        step = max(self.split_bytes, min(SPLIT_BYTES, sum(size for _, size in files) // SPLITS))
        for path, size in files:
            head = read_header(path)
            self.headers[path] = head
            for low in range(head.block, size, step):
                out.append(Split(path, low, min(size, low + step), head.inside if low == head.block else -1))
        return out or [Split("", 0, 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if not split.path:
            return
        chroms = (self.headers.get(split.path) or read_header(split.path)).chroms
        names = pa.array([*[c for c, _ in chroms], "*"])
        data, found = bytearray(), []
        for records in self._records(split, chroms):
            data, found = records
            fixed = np.frombuffer(data, np.uint8)[np.array(found)[:, None] + np.arange(4, 36)]
            ints = fixed.copy().view("<i4")
            ref, pos, next_ref, next_pos = ints[:, 0], ints[:, 1], ints[:, 5], ints[:, 6]
            flag = fixed[:, 14:16].copy().view("<u2").ravel().astype(np.int32)
            filters = np.zeros(len(found), np.int32)
            if self.tag:
                for i, at in enumerate(found):
                    size, _, _, l_name, _, _, n_cigar, _, l_seq, *_ = struct.unpack_from(_FIXED, data, at)
                    filters[i] = _filter_tag(data, at + 36 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq, at + 4 + size, self.tag)
            name = lambda r: names.take(pa.array(np.where(r < 0, len(chroms), r)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(flag), name(ref), pa.array(pos.astype(np.int64) + 1), pa.array(fixed[:, 9].astype(np.int32)), name(next_ref), pa.array(next_pos.astype(np.int64) + 1), pa.array(filters)],
                ["flag", "c1", "p1", "mapq", "c2", "p2", "filters"])

    def _records(self, split: Split, chroms: list[tuple[str, int]]) -> Iterator[tuple[bytes, list[int]]]:
        """Bytes and the places in them where records of the split begin, all of them whole."""
        blocks = _Blocks(split.path)
        place = split.low if split.inside >= 0 else blocks.first_from(split.low)
        if place >= split.high:
            return
        source = blocks.read(place)
        data = b""
        #: Up to here the blocks belong to the split.
        own, ended = 0, False

        def more() -> bool:
            nonlocal data, own, ended
            at, unpacked = next(source, (None, b""))
            if at is None:
                ended = True
                return False
            data += unpacked
            if at < split.high:
                own = len(data)
            return True

        more()
        at = split.inside if split.inside >= 0 else None
        if at is None:
            at = 0
            while not self._chain(lambda: data, at, chroms, more):
                at += 1
                if at >= own:  # no record begins in this block: go on to the next one of the split
                    if not more() or at >= own:
                        return
        found: list[int] = []
        while True:
            while at + 4 > len(data) and more():
                pass
            if at >= own or at + 4 > len(data):
                break
            size = int.from_bytes(data[at : at + 4], "little") + 4
            while at + size > len(data):
                if not more():
                    raise ValueError("the BAM file ends inside a record")
            found.append(at)
            at += size
            if len(found) >= BATCH or at > 8 << 20:
                yield data, found
                data, own, at, found = data[at:], max(0, own - at), 0, []
        if found:
            yield data, found

    @staticmethod
    def _chain(data, at: int, chroms: list[tuple[str, int]], more) -> bool:
        """Whether records follow one another from a place on; at the file's end fewer do."""
        for _ in range(CHAIN):
            size = _plausible(data(), at, chroms)
            while size < 0 and more():
                size = _plausible(data(), at, chroms)
            if size < 0:
                return at == len(data())
            if not size:
                return False
            at += size
            while at > len(data()):
                if not more():
                    return False
        return True


class BamSource(DataSource):
    """Format "bam": options path, filterTag (a tag that holds filter bits) and splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader({k.lower(): v for k, v in self.options.items()})


def read_bam(spark: SparkSession, path: str, filter_tag: str = "", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(flag, c1, p1, mapq, c2, p2, filters) of all reads of a BAM file or a folder of them; places count from 1, '*' is no chromosome.

    filters: the bits in the tag filter_tag, 0 for reads without it.
    """
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("filterTag", filter_tag).option("splitBytes", str(split_bytes)).load(path)


def bam_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(ord, chrom, size_bp) of the header of a BAM file, or of the first of a folder."""
    chroms = read_header(bam_files(path)[0][0]).chroms
    return spark.createDataFrame([(i, c, n) for i, (c, n) in enumerate(chroms)], "ord int, chrom string, size_bp bigint")


def _packed(data: bytes) -> bytes:
    """One BGZF block of at most 65,280 bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return MAGIC + b"\0\0\0\0\0\xff\x06\0BC\x02\0" + (len(body) + 25).to_bytes(2, "little") + body + zlib.crc32(data).to_bytes(4, "little") + len(data).to_bytes(4, "little")


def _fit(values: np.ndarray, kind: str) -> np.ndarray:
    out = values.astype(kind)
    if (out != values).any():
        raise OverflowError("a number of a read does not fit its field")
    return out


def _encoded(reads: pa.RecordBatch, names: pa.Array, tag: bytes) -> bytes:
    """Records of a batch of reads (flag, c1, p1, c2, p2, filters), called r0, r1 and on; those of names as long are made together."""
    if any(reads.column(i).null_count for i in (0, 2, 4, 5)):
        raise ValueError("a read without flag, place or filters")
    place = lambda i: _fit(reads.column(i).to_numpy(), "<i4")
    number = lambda i: pa.compute.index_in(reads.column(i).cast(pa.string()), value_set=names).fill_null(-1).to_numpy(zero_copy_only=False)
    flag, filters = _fit(reads.column(0).to_numpy(), "<u2"), place(5)
    ends = {"ref": number(1), "pos": place(2) - 1, "next_ref": number(3), "next_pos": place(4) - 1}
    out, low, digits = [], 0, 1
    while low < reads.num_rows:
        high = min(reads.num_rows, 10**digits)
        rows = np.zeros(high - low, [("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("next_ref", "<i4"), ("next_pos", "<i4"), ("length", "<i4"),
                                     ("r", "S1"), ("name", f"S{digits + 1}"), ("tag", "S3"), ("filters", "<i4")])
        rows["size"], rows["l_name"], rows["mapq"], rows["bin"], rows["r"], rows["tag"] = rows.itemsize - 4, digits + 2, 60, 4680, b"r", tag + b"i"
        rows["name"], rows["flag"], rows["filters"] = np.arange(low, high).astype(f"S{digits}"), flag[low:high], filters[low:high]
        for k, v in ends.items():
            rows[k] = v[low:high]
        out.append(rows.tobytes())
        low, digits = high, digits + 1
    return b"".join(out)


def write_bam(reads: DataFrame, chroms: list[tuple[str, int]], path: str, filter_tag: str = "XF", block_bytes: int = 65_280) -> int:
    """Reads (flag, c1, p1, c2, p2, filters) as BAM files in a folder, one for each partition; gives their number.

    Records have no sequence. A file gets its name when it is whole, and a task that runs again replaces it.
    """
    names = pa.array([c for c, _ in chroms], pa.string())
    text = "".join(f"@SQ\tSN:{c}\tLN:{n}\n" for c, n in chroms).encode()
    head = b"BAM\x01" + len(text).to_bytes(4, "little") + text + len(chroms).to_bytes(4, "little")
    for c, n in chroms:
        head += (len(c.encode()) + 1).to_bytes(4, "little") + c.encode() + b"\0" + n.to_bytes(4, "little")
    tag = filter_tag.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, folder = _open(path)
        system.create_dir(folder, recursive=True)
        name = f"{folder}/part-{task.partitionId():05d}"
        with system.open_output_stream(f"{name}.{task.taskAttemptId()}.tmp") as out:
            held = bytearray(head)
            for b in batches:
                held += _encoded(b, names, tag)
                while len(held) >= block_bytes:
                    out.write(_packed(bytes(held[:block_bytes])))
                    del held[:block_bytes]
            if held:
                out.write(_packed(bytes(held)))
            out.write(END)
        system.move(f"{name}.{task.taskAttemptId()}.tmp", f"{name}.bam")
        yield pa.RecordBatch.from_arrays([pa.array([1])], ["n"])

    rows = reads.select("flag", "c1", "p1", "c2", "p2", "filters")
    return rows.mapInArrow(run, "n bigint").count()
