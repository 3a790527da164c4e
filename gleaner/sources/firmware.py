"""Firmware scans: signature listings and extracted files."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Keywords in order, name patterns in order with severity, and key headers.
KEYWORDS = ("private key", "rsa private", "certificate", "passwd", "shadow", "root filesystem", "squashfs", "webserver")
LISTING = r"^(\d+)\s+(0x[0-9A-Fa-f]+)\s+(.+)$"
NAMES = (
    (r"^id_(rsa|dsa|ecdsa|ed25519)$", "high"),
    (r"^ssh_host_.*_key$", "high"),
    (r"(?i)^.*\.(pem|key|p12|pfx)$", "high"),
    (r"^shadow$", "high"),
    (r"^passwd$", "medium"),
    (r"^\.htpasswd$", "medium"),
    (r"^wpa_supplicant\.conf$", "medium"),
)
KEY_HEADERS = ("RSA ", "DSA ", "EC ", "OPENSSH ", "")
CONTENT_BYTES = 2 * 1024 * 1024
MAX_FILES = 20_000


def signatures(lines: DataFrame, line: str = "line") -> DataFrame:
    """Rows of a signature listing, with the first keyword that the description holds and its severity."""
    own = F.trim(F.regexp_replace(line, r"(?U)^\s+|\s+$", ""))
    rows = lines.withColumn("own", own).filter(F.col("own").rlike(LISTING))
    found = F.regexp_extract("own", LISTING, 3)
    keyword = F.try_element_at(F.filter(F.array(*[F.lit(k) for k in KEYWORDS]), lambda k: F.contains(F.lower(found), k)), F.lit(1))
    rows = rows.withColumns({"offset_decimal": F.regexp_extract("own", LISTING, 1).try_cast("long"), "offset_hex": F.regexp_extract("own", LISTING, 2), "title": found, "matched_keyword": keyword})
    return rows.withColumn("severity", F.when(F.col("matched_keyword").isNotNull(), "high").otherwise("info")).drop("own")


def name_severity(name: Column) -> Column:
    """The severity of the first pattern that a file's name fits."""
    level = F.lit(None).cast("string")
    for pattern, severity in reversed(NAMES):
        level = F.when(name.rlike(pattern), F.lit(severity)).otherwise(level)
    return level


def has_key(content: Column) -> Column:
    found = F.lit(False)
    for kind in KEY_HEADERS:
        found = found | F.contains(content, F.lit(f"-----BEGIN {kind}PRIVATE KEY-----"))
    return F.coalesce(found, F.lit(False))


def file_severity(name: Column, length: Column, content: Column) -> Column:
    """By name; else high if a file of at most CONTENT_BYTES holds a private key."""
    return F.coalesce(name_severity(name), F.when((length <= CONTENT_BYTES) & has_key(content), F.lit("high")))


def empty_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, content) of files without a byte, which Spark's file sources leave out.

    The folder's listing, which Spark's own reader makes on the driver as well, is walked once, and
    only the paths of empty files are held.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    listed, paths = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(folder, True), []
    while listed.hasNext():
        status = listed.next()
        if status.getLen() == 0:
            paths.append((status.getPath().toString(), 0, b""))
    return spark.createDataFrame(paths, "path string, length long, content binary")


def extracted_files(spark: SparkSession, root: str, most: int | None = None, target: str = "") -> DataFrame:
    """Files under a folder that are worth a finding, with their path in it.

    All files are, or with ``most`` the first so many by path, and ``truncated`` tells whether there are
    more; MAX_FILES is the limit of a scan that has one.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "content").unionByName(empty_files(spark, root))
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).resolvePath(base).toString().rstrip("/") + "/"
    name = F.element_at(F.split("path", "/"), -1)
    truncated = F.lit(False)
    if most is not None:
        paths = files.select("path").orderBy("path").limit(most + 1)
        truncated = F.lit(paths.count() > most)
        files = files.join(paths.orderBy("path").limit(most), "path", "left_semi")
    header = F.lit(False)
    for kind in KEY_HEADERS:
        header = header | F.contains("content", F.lit(f"-----BEGIN {kind}PRIVATE KEY-----".encode()))
    by_content = F.when((F.col("length") <= CONTENT_BYTES) & header, F.lit("high"))
    rows = files.withColumn("severity", F.coalesce(name_severity(name), by_content))
    # Without their schemes, as a store may write file:/ or file:///.
    bare = lambda c: F.regexp_replace(c, r"^[a-z0-9]+:/+", "/")
    inner = F.expr("substring(own, length(base) + 1)")
    rows = rows.withColumns({"own": bare(F.col("path")), "base": bare(F.lit(base))})
    return rows.filter("severity IS NOT NULL").select("path", name.alias("name"), F.when(F.expr("startswith(own, base)"), inner).otherwise(F.col("path")).alias("extracted_path"), F.col("length").alias("size_bytes"), "severity", F.concat(F.lit("Extracted file: "), name).alias("title"), F.lit(target).alias("target"), truncated.alias("truncated"))
