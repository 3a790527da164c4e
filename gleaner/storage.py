"""Tables in the folder that driver and executors share, to cut lineage and to release what was broadcast."""

from __future__ import annotations

import contextlib
import hashlib
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

from py4j.protocol import Py4JJavaError
from pyspark.errors import UnsupportedOperationException
from pyspark.sql import DataFrame, SparkSession

_open = threading.local()
#: Spark's bound on the bytes of an Arrow batch, and what it is set to for rows of some megabytes.
BATCH_BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "2m"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    It is what ``spark.checkpoint.dir`` names. Only a local session without one gets a folder of its
    own: on a cluster a local folder would be another one on each machine, so that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        one_machine = context.master.startswith("local") and not context.master.startswith("local-cluster")
        if named is None and not one_machine:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="gleaner-"))
    return context.getCheckpointDir()


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    folder, store = _folder(spark, path)
    store.delete(folder, True)


def rename(spark: SparkSession, path: str, to: str) -> bool:
    """Put a folder in another place in one step, unless something is there."""
    folder, store = _folder(spark, path)
    target = _folder(spark, to)[0]
    return not store.exists(target) and store.rename(folder, target)


def stamp(spark: SparkSession, paths: list[str]) -> str:
    """A digest of names, lengths and times of the files below some paths, so that a change of them is seen."""
    told = []
    for path in paths:
        folder, store = _folder(spark, path)
        listed = store.listFiles(folder, True)
        while listed.hasNext():
            status = listed.next()
            told.append(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(told)).encode()).hexdigest()[:16]


def read_text(spark: SparkSession, path: str) -> str:
    """A small file."""
    folder, store = _folder(spark, path)
    source = store.open(folder)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    folder, store = _folder(spark, path)
    target = store.create(folder, True)
    try:
        target.write(text.encode())
    finally:
        target.close()


def names(spark: SparkSession, path: str) -> dict[str, int]:
    """Names of the files and folders in a folder and when each was changed (ms); none if there is no such folder."""
    folder, store = _folder(spark, path)
    if not store.exists(folder):
        return {}
    return {status.getPath().getName(): status.getModificationTime() for status in store.listStatus(folder)}


def join_files(spark: SparkSession, paths: list[str], to: str) -> None:
    """One file of several, in their order: joined by the store if it can, else copied by the driver's JVM in pieces."""
    jvm = spark._jvm.org.apache.hadoop
    target, store = _folder(spark, to)
    sources = [jvm.fs.Path(p) for p in paths]
    if len(sources) > 1:
        array = spark.sparkContext._gateway.new_array(jvm.fs.Path, len(sources) - 1)
        for k, source in enumerate(sources[1:]):
            array[k] = source
        try:
            store.concat(sources[0], array)
            sources = sources[:1]
        except UnsupportedOperationException:
            pass
    if len(sources) == 1:
        store.rename(sources[0], target)
        return
    out = store.create(target, True)
    try:
        for source in sources:
            read = store.open(source)
            try:
                jvm.io.IOUtils.copyBytes(read, out, 1 << 20, False)
            finally:
                read.close()
    finally:
        out.close()


def rename_new(spark: SparkSession, path: str, to: str) -> bool:
    """Put a file in its place in one step; False if something is there."""
    jvm = spark._jvm.org.apache.hadoop.fs
    source, target = jvm.Path(path), jvm.Path(to)
    context = jvm.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    none[0] = jvm.Options.Rename.NONE
    try:
        context.rename(source, target, none)
    except Py4JJavaError as lost:
        if "FileAlreadyExists" in lost.java_exception.getClass().getName():
            return False
        raise
    return True


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Remove a folder when the session ends."""
    folder, store = _folder(spark, path)
    store.deleteOnExit(folder)


@contextlib.contextmanager
def temporary() -> Iterator[None]:
    """Tables that ``keep`` writes inside go when the block ends, but for those that outlive it."""
    scopes = _open.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        for spark, path in scopes.pop():
            remove(spark, path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, most: str = BATCH) -> Iterator[None]:
    """Plans that are run inside hand Arrow batches of about ``most`` bytes to Python, whatever the rows' size."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, most)
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


def grouped(rows: int) -> dict[str, str]:
    """Options of a Parquet writer for large rows: a row group, which writers and readers hold at once, has at most ``rows`` of them."""
    return {"parquet.block.row.count.limit": str(rows)}


def keep(df: DataFrame, outlive: bool = False, options: dict[str, str] | None = None) -> DataFrame:
    """Cut the lineage of ``df`` by a table in the shared folder.

    Unlike a checkpoint, a table carries nothing of the old plan along, so loops stay cheap on the
    driver, and it is compressed and read by column. It goes when the session ends, or when the
    ``temporary`` block around it does; with ``outlive`` the block around that one counts.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    scopes = _open.__dict__.get("scopes", [])
    scopes = scopes[:-1] if outlive else scopes
    if scopes:
        scopes[-1].append((spark, path))
    else:
        remove_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def once(spark: SparkSession, name: str, write: Callable[[str], object]) -> str:
    """The folder ``name`` in the shared folder, written when it is first asked for.

    What ``write`` puts into a draft is named in one step, so nobody reads it unfinished; of two
    writers one puts its own there, and both must write the same. It goes when the session ends.
    """
    path = f"{shared_dir(spark)}/{name}"
    folder, store = _folder(spark, path)
    if not store.exists(folder):
        draft = f"{path}-{uuid.uuid4().hex}"
        write(draft)
        if rename(spark, draft, path):
            remove_at_end(spark, path)
        else:
            remove(spark, draft)
    return path
