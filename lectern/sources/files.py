"""File listings and types (S20, S23, S26, F13, F24): Spark's own readers, and signatures as data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import base_name, extension

#: Extension, category, MIME type, and the leading bytes that tell it (offset and hex), all of which must be there. Of bytes the last that matches wins, of names the first.
TYPES: list[tuple[str, str, str, tuple[tuple[int, str], ...]]] = [
    ("js", "code", "text/javascript", ()),
    ("jsx", "code", "text/javascript", ()),
    ("mjs", "code", "text/javascript", ()),
    ("ts", "code", "text/typescript", ()),
    ("tsx", "code", "text/typescript", ()),
    ("py", "code", "text/x-python", ()),
    ("css", "code", "text/css", ()),
    ("html", "code", "text/html", ()),
    ("htm", "code", "text/html", ()),
    ("csv", "text", "text/csv", ()),
    ("txt", "text", "text/plain", ()),
    ("xml", "code", "text/xml", ()),
    ("md", "code", "text/markdown", ()),
    ("yaml", "code", "text/yaml", ()),
    ("yml", "code", "text/yaml", ()),
    ("sh", "code", "text/x-sh", ()),
    ("ttf", "font", "font/ttf", ((0, "0001000000"),)),
    ("otf", "font", "font/otf", ((0, "4F54544F"),)),
    ("woff", "font", "font/woff", ((0, "774F4646"),)),
    ("woff2", "font", "font/woff2", ((0, "774F4632"),)),
    ("jpg", "image", "image/jpeg", ((0, "FFD8FF"),)),
    ("jpeg", "image", "image/jpeg", ()),
    ("png", "image", "image/png", ((0, "89504E470D0A1A0A"),)),
    ("gif", "image", "image/gif", ((0, "47494638"),)),
    ("webp", "image", "image/webp", ((0, "52494646"), (8, "57454250"))),
    ("bmp", "image", "image/bmp", ((0, "424D"),)),
    ("tiff", "image", "image/tiff", ((0, "49492A00"),)),
    ("tiff", "image", "image/tiff", ((0, "4D4D002A"),)),
    ("ico", "image", "image/x-icon", ((0, "00000100"),)),
    ("avif", "image", "image/avif", ((4, "6674797061766966"),)),
    ("avif", "image", "image/avif", ((4, "6674797061766973"),)),
    ("svg", "image", "image/svg+xml", ()),
    ("mp3", "audio", "audio/mpeg", ((0, "494433"),)),
    ("mp3", "audio", "audio/mpeg", ((0, "FFFB"),)),
    ("wav", "audio", "audio/wav", ((0, "52494646"), (8, "57415645"))),
    ("ogg", "audio", "audio/ogg", ((0, "4F676753"),)),
    ("flac", "audio", "audio/flac", ((0, "664C6143"),)),
    ("mp4", "video", "video/mp4", ((4, "66747970"),)),
    ("avi", "video", "video/avi", ((0, "52494646"), (8, "41564920"))),
    ("webm", "video", "video/webm", ((0, "1A45DFA3"),)),
    ("pdf", "document", "application/pdf", ((0, "25504446"),)),
    ("doc", "document", "application/msword", ()),
    ("docx", "document", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ()),
    ("xls", "document", "application/vnd.ms-excel", ()),
    ("xlsx", "document", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", ()),
    ("ppt", "document", "application/vnd.ms-powerpoint", ()),
    ("pptx", "document", "application/vnd.openxmlformats-officedocument.presentationml.presentation", ()),
    ("odt", "document", "application/vnd.oasis.opendocument.text", ()),
    ("ods", "document", "application/vnd.oasis.opendocument.spreadsheet", ()),
    ("odp", "document", "application/vnd.oasis.opendocument.presentation", ()),
    ("zip", "archive", "application/zip", ((0, "504B0304"),)),
    ("rar", "archive", "application/x-rar-compressed", ((0, "526172211A07"),)),
    ("7z", "archive", "application/x-7z-compressed", ((0, "377ABCAF271C"),)),
    ("gz", "archive", "application/gzip", ((0, "1F8B"),)),
    ("bz2", "archive", "application/x-bzip2", ((0, "425A68"),)),
    ("xz", "archive", "application/x-xz", ((0, "FD377A585A00"),)),
    ("json", "code", "application/json", ()),
    ("exe", "executable", "application/x-msdownload", ((0, "4D5A"),)),
    ("elf", "executable", "application/x-elf", ((0, "7F454C46"),)),
    ("wasm", "executable", "application/wasm", ((0, "0061736D"),)),
    ("db", "database", "application/x-sqlite3", ((0, "53514C69746520"),)),
]


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``path, name, extension, size, modified`` of all files below ``root``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", base_name(F.col("path")).alias("name"), extension(F.col("path")).alias("extension"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def whole_texts(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """``path, text`` of the text files below ``root``."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def file_type(content: Column, path: Column) -> Column:
    """``struct(extension, category, mime)`` by leading bytes, else by the name's extension; zip gives way to the name."""
    def told(t):
        return F.struct(F.lit(t[0]).alias("extension"), F.lit(t[1]).alias("category"), F.lit(t[2]).alias("mime"))

    head = F.hex(F.substring(content, 1, 24))
    fits = lambda marks: reduce(lambda a, b: a & b, [F.substring(head, 2 * at + 1, len(mark)) == mark for at, mark in marks])
    by_bytes = F.coalesce(*[F.when(fits(t[3]), told(t)) for t in reversed(TYPES) if t[3]])
    suffix = F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1))
    by_name = F.coalesce(*[F.when(suffix == t[0], told(t)) for t in TYPES])
    return F.when(by_bytes["extension"] == "zip", F.coalesce(by_name, by_bytes)).otherwise(F.coalesce(by_bytes, by_name))


def first_levels(files: DataFrame, path: str = "path") -> DataFrame:
    """``name``: the first segment of paths relative to a root, folders with a slash at the end, each once."""
    parts = F.split(path, "/")
    return files.select(F.when(F.size(parts) > 1, F.concat(parts[0], F.lit("/"))).otherwise(parts[0]).alias("name")).distinct()


def documents_of(files: DataFrame, path: str = "path") -> DataFrame:
    """Files whose name begins with their folder's: an uploaded document, not what was made of it."""
    parts = F.split(path, "/")
    folder = F.get(parts, F.size(parts) - 2)
    return files.filter(F.coalesce(base_name(F.col(path)).startswith(folder), F.lit(False)))


def folder_of(files: DataFrame, name: str, path: str = "path") -> DataFrame:
    """The folder of the first file, by path, whose path ends in ``name``."""
    return files.filter(F.col(path).endswith(name)).orderBy(path).limit(1).select(F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("folder"))
