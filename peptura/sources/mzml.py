"""mzML spectra by a Python data source: files are read in byte ranges, or by their closing index where scans are asked for.

A range gives the spectra that begin in it, read to their ends beyond it. The file's head, up to its first spectrum, has the
parameter groups that spectra refer to; every range reads it. A filter on ``scan`` that Spark pushes down, or the option
``scans``, reads the index at the file's end and then the spectra asked for alone. Files are opened by pyarrow's file
systems; paths that only Spark can open are read as text, see scan_mzml.
"""

from __future__ import annotations

import base64
import re
import xml.etree.ElementTree as ET
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

SCHEMA = (
    "sample string, scan long, spectrum_id string, ms_level int, precursor_mz double, precursor_charge int, "
    "precursor_abundance double, retention_time double, peaks array<struct<id:int,mz:double,intensity:double>>"
)
#: Fixed accessions of the mzML vocabulary.
MS_LEVEL, FLOAT32, FLOAT64, ZLIB, PLAIN, MZ_ARRAY, INTENSITY_ARRAY = "MS:1000511", "MS:1000521", "MS:1000523", "MS:1000574", "MS:1000576", "MS:1000514", "MS:1000515"
INT32, INT64 = "MS:1000519", "MS:1000522"
SELECTED_MZ, CHARGE, PEAK_INTENSITY, START_TIME = "MS:1000744", "MS:1000041", "MS:1000042", "MS:1000016"
KINDS = {FLOAT32: "<f4", FLOAT64: "<f8", INT32: "<i4", INT64: "<i8"}
SCAN, BEGIN, END = re.compile(r"(?:scan|scanId)=(\d+)"), re.compile(rb"<spectrum[\s>]"), b"</spectrum>"
#: Of an index: its begin with its name, its end, or an entry with id and offset.
ENTRY = re.compile(rb"<index\s[^>]*name=[\"']([^\"']*)[\"'][^>]*>|</index>|<offset\s[^>]*?idRef=[\"']([^\"']*)[\"'][^>]*>\s*(\d+)\s*</offset>")
RANGE, BLOCK, LEAST, BATCH = 32 << 20, 1 << 20, 1 << 16, 200
#: Ranges beyond this number are made larger, up to RANGE: a task that reads one takes a tenth of a second besides.
RANGES = 1_000
#: Of the writer: scan numbers that go to one file, and the bytes up to which an array is not compressed.
SCANS, SHORT = 25_000, 512
Groups = dict[str, dict[str, str]]


@lru_cache(1024)
def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _name(node) -> str:
    return _local(node.tag)


def _params(node, groups: Groups) -> dict[str, str]:
    """Parameters of an element, those of the groups that it refers to first."""
    out: dict[str, str] = {}
    own: dict[str, str] = {}
    for c in node:
        name = _local(c.tag)
        if name == "cvParam":
            own[c.get("accession")] = c.get("value") or ""
        elif name == "referenceableParamGroupRef":
            if c.get("ref") not in groups:
                raise ValueError(f"no such parameter group: {c.get('ref')}")
            out |= groups[c.get("ref")]
    return out | own


def _under(node, name: str) -> Iterator:
    return (x for x in node.iter() if _name(x) == name)


def _values(node, kind: dict[str, str]) -> np.ndarray:
    """The numbers of a binary array: floats or integers of 32 or 64 bits, plain or by zlib."""
    raw = base64.b64decode(next(_under(node, "binary")).text or "")
    kinds = [k for k in KINDS if k in kind]
    if len(kinds) != 1 or not (ZLIB in kind or PLAIN in kind):
        raise ValueError(f"an array of a kind that is not read: {sorted(kind)}")
    return np.frombuffer(zlib.decompress(raw) if ZLIB in kind and raw else raw, KINDS[kinds[0]]).astype(float, copy=False)


def head_of(text: bytes) -> tuple[str, Groups]:
    """The encoding and the parameter groups that a file's head, the text before its first spectrum, declares."""
    found = re.match(rb"[\xef\xbb\xbf\s]*<\?xml[^>]*encoding=[\"']([\w.-]+)", text)
    encoding = found[1].decode() if found else "utf-8"
    listed = re.search(rb"<referenceableParamGroupList.*?</referenceableParamGroupList>", text, re.DOTALL)
    if listed is None:
        return encoding, {}
    return encoding, {g.get("id"): _params(g, {}) for g in _under(ET.fromstring(listed[0].decode(encoding)), "referenceableParamGroup")}


def parse_spectrum(text: str, sample: str, groups: Groups | None = None) -> dict:
    """One ``<spectrum>`` element. groups: the file's parameter groups by id."""
    node, groups = ET.fromstring(text), groups or {}
    own, arrays, ion, start = _params(node, groups), {}, None, None
    for x in node.iter():
        tag = _local(x.tag)
        if tag == "binaryDataArray":
            kind = _params(x, groups)
            name = "mz" if MZ_ARRAY in kind else "intensity" if INTENSITY_ARRAY in kind else None
            if name:
                arrays[name] = _values(x, kind)
        elif tag == "selectedIon" and ion is None:
            ion = _params(x, groups)
        elif tag == "scan" and start is None:
            start = _params(x, groups).get(START_TIME, "")
    ion = ion or {}
    found = SCAN.search(node.get("id", ""))
    number = lambda k, kind: kind(float(ion[k])) if ion.get(k) else None
    return {
        "sample": sample, "scan": int(found[1]) if found else None, "spectrum_id": node.get("id"), "ms_level": int(own.get(MS_LEVEL) or 1),
        "precursor_mz": number(SELECTED_MZ, float), "precursor_charge": number(CHARGE, int), "precursor_abundance": number(PEAK_INTENSITY, float),
        "retention_time": float(start) if start else None, "mz": arrays.get("mz", np.empty(0)), "intensity": arrays.get("intensity", np.empty(0)),
    }


def as_batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.float64(), pa.float64())
    names = [f.partition(" ")[0] for f in SCHEMA.split(", ")]
    columns = [pa.array([r[n] for r in rows], kind) for n, kind in zip(names[:-1], kinds, strict=True)]
    sizes = [min(len(r["mz"]), len(r["intensity"])) for r in rows]
    flat = lambda x: pa.array(np.concatenate([np.empty(0), *x]))
    ids = pa.array(np.concatenate([np.empty(0, np.int32), *[np.arange(n, dtype=np.int32) for n in sizes]]))
    peaks = pa.StructArray.from_arrays([ids, *[flat(r[c][:n] for r, n in zip(rows, sizes, strict=True)) for c in ("mz", "intensity")]], ["id", "mz", "intensity"])
    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), peaks))
    return pa.RecordBatch.from_arrays(columns, names=names)


def _sample(path: str) -> str:
    return path.rpartition("/")[2].split(".")[0]


@dataclass
class Range(InputPartition):
    """The spectra of a file that begin within [start, end), or those of some scans wherever they are."""

    path: str
    start: int
    end: int
    scans: tuple[int, ...] | None = None


class _File:
    """A file read in blocks."""

    def __init__(self, system: fs.FileSystem, path: str):
        self.own, self.sample = system.open_input_file(path), _sample(path)
        self.size, head = self.own.size(), b""
        while BEGIN.search(head) is None and len(head) < self.size:
            head += self.at(len(head), max(LEAST, len(head)))
        first = BEGIN.search(head)
        self.encoding, self.groups = head_of(head[: first.start()] if first else head)

    def at(self, offset: int, size: int) -> bytes:
        return self.own.read_at(min(size, max(0, self.size - offset)), offset)

    def parsed(self, raw: bytes) -> dict:
        return parse_spectrum(raw.decode(self.encoding), self.sample, self.groups)

    def within(self, start: int, end: int) -> Iterator[bytes]:
        """The elements that begin within [start, end)."""
        held, offset, done = b"", start, 0
        while True:
            found = BEGIN.search(held, done)
            if found and offset + found.start() >= end:
                return
            if found and (stop := held.find(END, found.start())) >= 0:
                done = stop + len(END)
                yield held[found.start() : done]
                continue
            keep = found.start() if found else max(done, len(held) - 12)  # a tag may be cut at the block's end
            held, offset, done = held[keep:], offset + keep, 0
            # without a begun element, only as much as a tag needs is read beyond the end
            if offset + len(held) >= self.size or (found is None and offset >= end):
                return
            at = offset + len(held)
            held += self.at(at, max(LEAST, min(BLOCK, end - at), len(held)))

    def indexed(self, scans: tuple[int, ...]) -> list[int] | None:
        """The offsets that the closing index names for some scans, None where there is none. It is read in blocks, and only
        what is asked for is kept."""
        tail = self.at(max(0, self.size - 4096), 4096)
        at = re.search(rb"<indexListOffset>\s*(\d+)\s*</indexListOffset>", tail)
        if at is None or int(at[1]) >= self.size:
            return None
        asked, out, held, offset, spectra = set(scans), [], b"", int(at[1]), False
        while offset < self.size:
            block = self.at(offset, BLOCK)
            held, offset, done = held + block, offset + len(block), 0
            for m in ENTRY.finditer(held):
                done = m.end()
                if m[3] is None:
                    spectra = m[1] == b"spectrum"
                elif spectra and (found := SCAN.search(m[2].decode(self.encoding))) and int(found[1]) in asked:
                    out.append(int(m[3]))
            held = held[done:]
        return sorted(out)

    def of_scans(self, scans: tuple[int, ...]) -> Iterator[bytes]:
        places = index = self.indexed(scans)
        if index is None or any(not BEGIN.match(self.at(o, 16)) for o in places):
            yield from self.within(0, self.size)  # the caller drops the others
            return
        for o in places:
            yield next(self.within(o, o + 1))


def _parts(system: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    """A sample's file ``<sample>.mzML`` and its further ones, ``<sample>.part-<number>.mzML``: those that there are."""
    folder, _, name = path.rpartition("/")
    own = re.compile(re.escape(name.removesuffix(".mzML")) + r"(\.part-\d+)?\.mzML")
    there = system.get_file_info(fs.FileSelector(folder or ".", allow_not_found=True))
    return sorted((f for f in there if f.type == fs.FileType.File and own.fullmatch(f.base_name)), key=lambda f: f.path)


class MzmlReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        paths = options.get("paths") or options.get("path") or ""
        self.paths = [p for p in paths.split("\n") if p]
        self.ms2_only = options.get("ms2_only", "true").lower() == "true"
        self.parts = options.get("parts", "false").lower() == "true"
        self.range = int(options.get("range_bytes", RANGE))
        self.scans = tuple(map(int, options["scans"].split(","))) if options.get("scans") else None

    def _files(self) -> Iterator[tuple[str, str, int]]:
        for p in self.paths:
            system, inner = fs.FileSystem.from_uri(p) if "://" in p or p.startswith("file:") else (fs.LocalFileSystem(), p)
            if self.parts:
                found = _parts(system, inner)
                if not found:
                    raise FileNotFoundError(p)
                yield from ((p[: len(p) - len(inner)] + f.path if p.endswith(inner) else f.path, f.path, f.size) for f in found)
                continue
            info = system.get_file_info(inner)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(p)
            if info.type == fs.FileType.File:
                yield p, inner, info.size
                continue
            root = p[: len(p) - len(inner)] if p.endswith(inner) else ""
            for f in sorted(system.get_file_info(fs.FileSelector(inner, recursive=True)), key=lambda f: f.path):
                if f.type == fs.FileType.File and f.path.endswith(".mzML"):
                    yield root + f.path, f.path, f.size

    def partitions(self) -> list[Range]:
        out, files = [], list(self._files())
        step = max(self.range, min(RANGE, sum(f[2] for f in files) // RANGES))
        for path, _, size in files:
            if self.scans is not None:
                out.append(Range(path, 0, size, self.scans))
            else:
                out += [Range(path, s, min(s + step, size)) for s in range(0, size, step)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        p = partition.path
        system, inner = fs.FileSystem.from_uri(p) if "://" in p or p.startswith("file:") else (fs.LocalFileSystem(), p)
        file, rows = _File(system, inner), []
        raw = file.within(partition.start, partition.end) if partition.scans is None else file.of_scans(partition.scans)
        for s in map(file.parsed, raw):
            if (self.ms2_only and s["ms_level"] == 1) or (partition.scans is not None and s["scan"] not in partition.scans):
                continue
            rows.append(s)
            if len(rows) >= BATCH:
                yield as_batch(rows)
                rows = []
        if rows:
            yield as_batch(rows)


class PushedReader(MzmlReader):
    """Takes filters on scan: Spark need not apply them again."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("scan",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                asked = {int(x) for x in asked if x is not None}
                self.scans = tuple(sorted(asked if self.scans is None else asked & set(self.scans)))
            else:
                yield f


class MzmlSource(DataSource):
    """``spark.read.format("mzml")``. Options: path, or paths by line; parts: whether a path stands for a sample's further files
    too; ms2_only; scans, joined by commas; range_bytes; pushdown: whether the session pushes filters to Python sources (spark.sql.python.filterPushdown.enabled)."""

    @classmethod
    def name(cls) -> str:
        return "mzml"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (PushedReader if self.options.get("pushdown", "false").lower() == "true" else MzmlReader)(dict(self.options))


def _opened_here(path: str) -> bool:
    """Whether pyarrow has a file system for a path."""
    if "://" not in path:
        return True
    try:
        fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, OSError):
        return False
    return True


def scan_mzml(spark: SparkSession, path, ms2_only: bool = True, scans: list[int] | None = None, range_bytes: int = RANGE, parts: bool = False) -> DataFrame:
    """Spectra of a file, folder (``*.mzML``, any depth) or list of them; sample is the file's name up to its first dot.

    scans: these alone, by the files' indexes. parts: a path ``<sample>.mzML`` stands for the sample's further files too. Where pyarrow has no file system for a path, files are read as text records
    that end where a spectrum ends; a spectrum there that refers to a parameter group is an error, as the head is in
    another record.
    """
    paths = [path] if isinstance(path, str) else [str(p) for p in path] if isinstance(path, list | tuple) else [str(path)]
    if not all(map(_opened_here, paths)):
        df = _as_text(spark, [p.removesuffix(".mzML") + "{.mzML,.part-*.mzML}" for p in paths] if parts else paths)
        df = df if scans is None else df.where(F.col("scan").isin(*scans))
        return df.where("ms_level <> 1") if ms2_only else df
    spark.dataSource.register(MzmlSource)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    own = {"paths": "\n".join(paths), "ms2_only": str(ms2_only).lower(), "range_bytes": str(range_bytes), "pushdown": pushed, "parts": str(parts).lower()}
    if scans is not None:
        own["scans"] = ",".join(map(str, scans))
    return spark.read.format("mzml").options(**own).load()


def _as_text(spark: SparkSession, paths: list[str]) -> DataFrame:
    files = spark.read.option("pathGlobFilter", "*.mzML").option("recursiveFileLookup", "true").option("lineSep", END.decode()).text(paths)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            records = ((n, BEGIN.search(t.encode()), t.encode()) for n, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            rows = [parse_spectrum((raw[at.start() :] + END).decode(), _sample(n)) for n, at, raw in records if at]
            if rows:
                yield as_batch(rows)

    return files.select(F.col("_metadata.file_name").alias("name"), "value").mapInArrow(decode, SCHEMA)


def spectrum_by_index(spark: SparkSession, path: str, scan: int) -> DataFrame:
    """The spectrum of a scan, read by the file's index."""
    return get_spectrum(scan_mzml(spark, path, ms2_only=False, scans=[scan]), scan)


def get_spectrum(spectra: DataFrame, scan: int, sample: str | None = None) -> DataFrame:
    """The one spectrum of a scan; none or several are an error."""
    df = spectra.where(F.col("scan") == scan)
    df = df if sample is None else df.where(F.col("sample") == sample)
    n = df.count()
    if n != 1:
        raise ValueError(f"{n} spectra of scan {scan}")
    return df


def load_samples(spark: SparkSession, folder: str, samples: list[str], ms2_only: bool = True) -> DataFrame:
    """The spectra of several samples: ``<folder>/<sample>.mzML`` each, and what write_mzml put in further files."""
    return scan_mzml(spark, [f"{folder.rstrip('/')}/{s}.mzML" for s in samples], ms2_only, parts=True)


#: Fixed form of the file names of numbered fractions.
FRACTION = "BMEM_AspN_Fxn{}"


def spectrum_by_sample_scan(spectra: DataFrame, sample: str | int, scan: int, fraction: str = FRACTION) -> DataFrame:
    """The first spectrum of a scan, by sample name or by the number of a fraction; empty if there is none."""
    name = fraction.format(sample) if isinstance(sample, int) else sample
    return spectra.where((F.col("sample") == name) & (F.col("scan") == scan)).orderBy("spectrum_id").limit(1)


def mzml_scans(spectra: DataFrame) -> DataFrame:
    """sample, scan: the scan numbers of each sample."""
    return spectra.select("sample", "scan").distinct()


def mzml_name(file: Column) -> Column:
    """A file's name without its folder and ``.mzML``."""
    return F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.mzML$", "")


def mzml_sample(file: Column) -> Column:
    """A file's name up to its last dot."""
    return F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.[^.]*$", "")


def exploded_peaks(spectra: DataFrame) -> DataFrame:
    """sample, scan, peak_id, mz, intensity."""
    df = spectra.select("sample", "scan", F.explode("peaks").alias("p"))
    return df.select("sample", "scan", F.col("p.id").cast("long").alias("peak_id"), F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity"))


def _cv(accession: str, value="") -> str:
    return f'<cvParam cvRef="MS" accession="{accession}" name="" value="{value}"/>'


def _array(raw: bytes, kind: str) -> str:
    """Doubles. Few of them are written as they are: compressed they would be longer."""
    group = "plain" if len(raw) <= SHORT else "array"
    text = base64.b64encode(raw if len(raw) <= SHORT else zlib.compress(raw)).decode()
    return f'<binaryDataArray encodedLength="{len(text)}"><referenceableParamGroupRef ref="{group}"/>{_cv(kind)}<binary>{text}</binary></binaryDataArray>'


def _peaks_of(peaks: pa.ListArray) -> Iterator[tuple[bytes, bytes]]:
    """The bytes of every list's m/z and intensities, by id."""
    offsets = peaks.offsets.to_numpy()
    first, sizes = int(offsets[0]), np.diff(offsets)
    ids, mz, intensity = (c.to_numpy(zero_copy_only=False) for c in peaks.values.slice(first, int(offsets[-1]) - first).flatten())
    order = np.lexsort((ids, np.repeat(np.arange(len(sizes)), sizes)))
    mz, intensity = (x[order].astype("<f8").tobytes() for x in (mz, intensity))
    for a, b in zip((8 * (offsets[:-1] - first)).tolist(), (8 * (offsets[1:] - first)).tolist(), strict=True):
        yield mz[a:b], intensity[a:b]


def write_mzml(spectra: DataFrame, folder: str) -> DataFrame:
    """Writes spectra (sample, scan, precursor_mz, precursor_charge, peaks: id, mz, intensity) as mzML files with an index;
    returns (file, n).

    A sample's scan numbers below SCANS are in ``<folder>/<sample>.mzML``, every SCANS further ones in a file of their own,
    ``<sample>.part-<number>.mzML``, so the tasks of one sample share its work. A task writes its files one after another, a
    spectrum at a time; a file gets its name when it is whole, so a task that is run again does no harm. Further files of a
    sample that an earlier call has left are deleted at the end.
    """
    group = lambda name, *cv: f'<referenceableParamGroup id="{name}">{"".join(cv)}</referenceableParamGroup>'
    groups = group("ms2", _cv(MS_LEVEL, 2)) + group("array", _cv(FLOAT64), _cv(ZLIB)) + group("plain", _cv(FLOAT64), _cv(PLAIN))
    groups = f'<referenceableParamGroupList count="3">{groups}</referenceableParamGroupList>'
    head = f'<?xml version="1.0" encoding="utf-8"?>\n<indexedmzML xmlns="http://psi.hupo.org/ms/mzml"><mzML>{groups}<run><spectrumList>\n'.encode()

    def opened() -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)

    def element(scan: int | None, mz: float | None, charge: int | None, values: tuple[bytes, bytes]) -> bytes:
        ion = "".join(_cv(a, v) for a, v in ((SELECTED_MZ, mz), (CHARGE, charge)) if v is not None)
        ion = f"<precursorList><precursor><selectedIonList><selectedIon>{ion}</selectedIon></selectedIonList></precursor></precursorList>" if ion else ""
        arrays = _array(values[0], MZ_ARRAY) + _array(values[1], INTENSITY_ARRAY)
        return f'<spectrum id="scan={scan}"><referenceableParamGroupRef ref="ms2"/>{ion}<binaryDataArrayList>{arrays}</binaryDataArrayList></spectrum>\n'.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = opened()
        system.create_dir(root)
        out, own, n, at = None, None, 0, 0
        scans, offsets = array("q"), array("q")  # 16 bytes a spectrum

        def closed() -> pa.RecordBatch:
            out.write(b"</spectrumList></run></mzML>\n")
            out.write(b'<indexList count="1"><index name="spectrum">\n')
            for i in range(0, len(offsets), 10_000):
                out.write("".join(f'<offset idRef="scan={s}">{o}</offset>\n' for s, o in zip(scans[i : i + 10_000], offsets[i : i + 10_000], strict=True)).encode())
            begin = at + len(b"</spectrumList></run></mzML>\n")
            out.write(f"</index></indexList>\n<indexListOffset>{begin}</indexListOffset></indexedmzML>\n".encode())
            out.close()
            name = f"{own[0]}.part-{own[1]:06d}.mzML" if own[1] else f"{own[0]}.mzML"
            system.move(begun, f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([own[0]]), pa.array([name]), pa.array([n], pa.int64())], names=["sample", "name", "n"])

        for b in batches:
            for *key, scan, mz, charge, values in zip(*(b.column(i).to_pylist() for i in range(5)), _peaks_of(b.column(5)), strict=True):
                if key != own:
                    if out is not None:
                        yield closed()
                    own, n, scans, offsets = key, 0, array("q"), array("q")
                    begun = f"{root}/_{key[0]}-{key[1]}-{TaskContext.get().taskAttemptId()}"
                    out = system.open_output_stream(begun, buffer_size=BLOCK)
                    out.write(head)
                    at = len(head)
                n += 1
                if scan is not None:
                    scans.append(scan)
                    offsets.append(at)
                text = element(scan, mz, charge, values)
                out.write(text)
                at += len(text)
        if out is not None:
            yield closed()

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened()
        written: dict[str, list[tuple[str, int]]] = {}
        for b in batches:
            for sample, name, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                written.setdefault(sample, []).append((name, n))
        for sample, files in written.items():
            names = {name for name, _ in files}
            for f in _parts(system, f"{root}/{sample}.mzML"):
                if f.base_name not in names:
                    system.delete_file(f.path)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}" for name, _ in files]), pa.array([n for _, n in files], pa.int64())], names=["file", "n"])

    block = F.floor(F.abs(F.coalesce("scan", F.lit(0))) / SCANS).alias("block")
    df = spectra.where("sample is not null").select("sample", block, "scan", "precursor_mz", "precursor_charge", "peaks")
    files = df.repartition("sample", "block").sortWithinPartitions("sample", "block", "scan").mapInArrow(run, "sample string, name string, n long")
    return files.repartition("sample").mapInArrow(ended, "file string, n long")
