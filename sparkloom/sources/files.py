"""Files of a repository: walked by Spark, listed by git, or named by a diff."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import paths

#: A NUL byte in so many first bytes makes a file binary.
LOOK = 8192


def scan_walk(spark: SparkSession, root: str, *, extra: Sequence[str] = (), all_files: bool = False) -> DataFrame:
    """(path, size, content) of the files below root, paths relative to it; without all_files those to index.

    The listing is Spark's own, so root may lie in any store; content is read only where it is selected.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    bare = F.regexp_replace(F.col("path"), "^[a-zA-Z0-9+.-]+:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    at = F.instr(bare, base)
    rel = F.when(at > 0, F.substring(bare, at + len(base), F.length(bare))).otherwise(F.element_at(F.split(bare, "/"), -1))
    f = f.select(F.url_decode(F.replace(rel, F.lit("+"), F.lit("%2B"))).alias("path"), F.col("length").alias("size"), "content").filter("size > 0")
    f = f.unionByName(_passed_over(spark, root))
    return f if all_files else f.filter(paths.should_index(F.col("path"), extra))


def _passed_over(spark: SparkSession, root: str) -> DataFrame:
    """The files that Spark's own listing leaves out: those whose name begins with an underscore, and empty ones.

    Their names are listed on the driver; the tasks read them, by the local file system or by Arrow's.
    """
    local = _local(root)
    names: list[tuple[str, int]] = []
    if local is not None:
        for at, dirs, found in os.walk(local):
            dirs[:] = sorted(d for d in dirs if not d.startswith("."))
            part = os.path.relpath(at, local)
            for n in sorted(found):
                size = os.path.getsize(os.path.join(at, n)) if os.path.exists(os.path.join(at, n)) else None
                below = "/_" in f"/{part}"
                if size is not None and not n.startswith(".") and (below or n.startswith("_") or size == 0):
                    names.append((n if part == "." else f"{part}/{n}", size))
    else:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        it = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
        base = path.toUri().getPath().rstrip("/") + "/"
        while it.hasNext():
            s = it.next()
            rel = s.getPath().toUri().getPath().split(base, 1)[-1]
            if not any(x.startswith(".") for x in rel.split("/")) and ("/_" in f"/{rel}" or s.getLen() == 0):
                names.append((rel, s.getLen()))
    return read_listed(spark.createDataFrame(names, "path string, size long"), root)


def read_listed(listed: DataFrame, root: str) -> DataFrame:
    """(path, size, content) of the named files below root alone, read by the tasks; a file that is gone has null content."""
    local = _local(root)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths_, sizes = (batch.column(i).to_pylist() for i in range(2))
            found = [b"" if n == 0 else _bytes(root, local, p) for p, n in zip(paths_, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if b is None else len(b) for b in found], pa.int64()), pa.array(found, pa.binary())], ["path", "size", "content"])

    return listed.mapInArrow(read, "path string, size long, content binary")


def _local(root: str) -> str | None:
    return root[5:] if root.startswith("file:") else root if "://" not in root else None


def _bytes(root: str, local: str | None, name: str) -> bytes | None:
    if local is not None:
        if not os.path.isfile(os.path.join(local, name)):
            return None
        with open(os.path.join(local, name), "rb") as f:
            return f.read()
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root)
    with store.open_input_stream(f"{base.rstrip('/')}/{name}") as f:
        return f.read()


def read_text(content: Column) -> Column:
    """The bytes as UTF-8 with replacement characters; null if they are null or look binary."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.when(~F.make_valid_utf8(F.substring(content, 1, LOOK).cast("string")).contains("\0"), text)


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, check=True, text=True, timeout=300).stdout


def scan_git(spark: SparkSession, root: str) -> DataFrame:
    """(path): tracked files and untracked ones that aren't ignored, each once, by git on the driver (a list of names)."""
    names = dict.fromkeys(x for x in (_git(root, "ls-files", "-z") + _git(root, "ls-files", "-z", "--others", "--exclude-standard")).split("\0") if x)
    return spark.createDataFrame([(n,) for n in names], "path string")


def head(root: str) -> str | None:
    try:
        return _git(root, "rev-parse", "HEAD").strip()
    except (OSError, subprocess.SubprocessError):
        return None


def clean(root: str) -> bool:
    """Whether the tracked files are as the last commit has them."""
    return not _git(root, "status", "--porcelain", "--untracked-files=no", ".").strip()


def parse_name_status(text: Column) -> Column:
    """Changes (path, op with A, M or D) out of NUL-separated name-status output.

    A rename or copy is a deletion of the first path and an addition of the second; other kinds are modifications. The changes
    are matched one after another, each status with its paths, so the cost follows the output's length.
    """
    moved, other = r"[RC][0-9]*\x00[^\x00]+\x00[^\x00]+", r"[A-Z][0-9]*\x00[^\x00]+"

    def read(change):
        kind, parts = F.substring(change, 1, 1), F.split(change, "\0", -1)
        one = lambda i, op: F.struct(F.get(parts, F.lit(i)).alias("path"), op.alias("op"))
        return F.when(kind.isin("R", "C"), F.array(one(1, F.lit("D")), one(2, F.lit("A")))).otherwise(F.array(one(1, F.when(kind.isin("A", "D"), kind).otherwise("M"))))

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(f"(?:{moved}|{other})\\x00?"), F.lit(0)), read))


def scan_diff(spark: SparkSession, root: str, base: str, to: str = "HEAD") -> DataFrame:
    """(path, op) of what changed between two commits."""
    out = spark.createDataFrame([(_git(root, "diff", "--relative", "--name-status", "-z", base, to),)], "z string")
    return out.select(F.explode(parse_name_status(F.col("z"))).alias("c")).select("c.*")


def changed_since(spark: SparkSession, root: str, base: str | None, known: DataFrame) -> DataFrame | None:
    """(path, op) of what differs from a commit in the working tree; None if git can't tell, as without a repository or if the commit is gone.

    `known` names the files (path) that are indexed: those that git neither tracks nor finds are deletions.
    """
    if not base or head(root) is None:
        return None
    try:
        _git(root, "cat-file", "-e", f"{base}^{{commit}}")
        text = _git(root, "diff", "--relative", "--name-status", "-z", base)
        names = scan_git(spark, root)
    except (OSError, subprocess.SubprocessError):
        return None
    loose = [(n,) for n in _git(root, "ls-files", "-z", "--others", "--exclude-standard").split("\0") if n]
    told = spark.createDataFrame([(text,)], "z string").select(F.explode(parse_name_status(F.col("z"))).alias("c")).select("c.*")
    fresh = spark.createDataFrame(loose, "path string").select("path", F.lit("M").alias("op"))
    gone = known.select("path").join(names, "path", "left_anti").select("path", F.lit("D").alias("op"))
    # A path that is told of twice is there if anything says so.
    return told.unionByName(fresh).unionByName(gone).groupBy("path").agg(F.when(F.min("op") == "D", F.when(F.max("op") == "D", "D").otherwise("M")).otherwise(F.min("op")).alias("op"))
