"""The load router: directories, single files and fetched pages to one frame of documents."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkweave import schemas
from inkweave.functions import urls
from inkweave.operators.ordering import number_documents
from inkweave.sources.documents import document_registry, filter_doc_types
from inkweave.sources.files import FileLoader, LoadedFiles, scan_directory, too_long
from inkweave.sources.web import web_documents


class LoadError(Exception):
    """A source that had to load did not."""


#: Paths that are looked at at the same time, and named files up to which the list of them is sent to every executor.
LOOKUPS, BROADCAST_PATHS = 32, 10_000


def _located(spark: SparkSession, path: str) -> tuple[str, bool]:
    """The path as scans name it, and whether it is a folder."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = location.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(location):
        raise LoadError(f"source not found: {path}")
    return files.makeQualified(location).toString(), files.getFileStatus(location).isDirectory()


def _located_all(spark: SparkSession, paths: list[str]) -> list[tuple[str, bool]]:
    """As ``_located``, many at a time: a lookup waits for the store, not for the driver."""
    with ThreadPoolExecutor(LOOKUPS) as pool:
        return list(pool.map(lambda p: _located(spark, p), paths))


def _file_types(doc_types: list[str] | None) -> tuple[str, ...]:
    if doc_types is None:
        return schemas.FILE_TYPES
    unknown = set(doc_types) - set(schemas.DOCUMENT_TYPES)
    if unknown:
        raise ValueError(f"unknown document types: {sorted(unknown)}")
    return tuple(t for t in schemas.FILE_TYPES if t in doc_types)


def load_sources(
    spark: SparkSession,
    sources: str | list[str],
    *,
    pages: DataFrame | None = None,
    doc_types: list[str] | None = None,
    loader: FileLoader | None = None,
    recursive: bool = True,
    exclude_name_contains: tuple[str, ...] = (),
    ordered: bool = False,
    once: bool = False,
) -> LoadedFiles:
    """Documents of directories, single files and web addresses, and the files that could not be read.

    Directories load permissively: what cannot be read, has no parser or is longer than a cell goes to quarantine.
    Single sources fail fast; a file that is named and lies in a named directory as well is loaded once, as named.
    Addresses are looked up in ``pages(url, html)``, the pages fetched beforehand. All directories are one scan, all
    single files another. Files of other types than ``doc_types`` are told by their names and never opened.

    With ``ordered`` the documents have ``doc_seq``, their place in the order of ``sources``; a directory's files follow
    each other by path. That sorts and writes them. With ``once`` the files of directories are read once and written,
    whatever is asked of documents, quarantine and report.
    """
    loader = loader or FileLoader()
    given = [sources] if isinstance(sources, str) else list(sources)
    types = _file_types(doc_types)
    is_address = [s.lower().startswith(("http://", "https://")) for s in given]
    local = [i for i, a in enumerate(is_address) if not a]
    located = dict(zip(local, _located_all(spark, [given[i] for i in local]), strict=True))
    folders, singles = {}, {}  # each with the place where it is first named
    for i, (path, is_folder) in located.items():
        (folders if is_folder else singles).setdefault(path, i)
    addresses = [(i, s) for i, s in enumerate(given) if is_address[i]]

    frames, lost, counted = [], [], None
    if folders and types:
        options = {"recursive": recursive, "exclude_name_contains": exclude_name_contains, "types": types}
        files = scan_directory(spark, list(folders), **options)
        if singles:
            named = spark.createDataFrame([(p,) for p in singles], "path string")
            files = files.join(F.broadcast(named) if len(singles) <= BROADCAST_PATHS else named, "path", "left_anti")
        # a file longer than a cell is told by its listing; its content is never asked for
        most = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))
        short = files.where(F.col("length") <= most)
        loaded = loader.load_once(short, types) if once else loader.load(short, "permissive", types)
        long = too_long(files.where(F.col("length") > most))
        frames.append(loaded.documents.withColumn("_named", _first_folder(F.col("source"), folders)))
        lost += [loaded.quarantine, long]
        if once:
            counted = (loaded.counted[0], loaded.counted[1] + long.count())
    wanted = {p: i for p, i in singles.items() if doc_types is None or p.rsplit(".", 1)[-1].lower() in types}
    if wanted:
        files = spark.read.format("binaryFile").load(list(wanted))
        documents = loader.load(files, "failfast", types).documents
        place = spark.createDataFrame(list(wanted.items()), "source string, _named int")
        documents = documents.join(F.broadcast(place) if len(wanted) <= BROADCAST_PATHS else place, "source") if ordered else documents.withColumn("_named", F.lit(0))
        frames.append(documents)
        counted = counted and (counted[0] + len(wanted), counted[1])
    if addresses and (doc_types is None or "url" in doc_types):
        if pages is None:
            raise LoadError("web addresses need the table of fetched pages")
        frames.append(web_documents(fetched_pages(spark, addresses, pages), carry=("request",)).withColumnRenamed("request", "_named"))
        counted = counted and (counted[0] + len(addresses), counted[1])
    nothing = spark.createDataFrame([], schemas.DOCUMENT)
    documents = filter_doc_types(reduce(DataFrame.unionByName, frames), doc_types) if frames else nothing
    if ordered and frames:
        documents = number_documents(documents, ["_named", "source"])
    quarantine = reduce(DataFrame.unionByName, lost) if lost else spark.createDataFrame([], schemas.QUARANTINE)
    return LoadedFiles(schemas.conform(documents, schemas.DOCUMENT), quarantine, counted)


def _first_folder(source: Column, folders: dict[str, int]) -> Column:
    """Where the first of the folders that a file lies in was named."""
    listed = F.array(*[F.struct(F.lit(f.rstrip("/") + "/").alias("folder"), F.lit(i).alias("place")) for f, i in folders.items()])
    return F.array_min(F.transform(F.filter(listed, lambda f: source.startswith(f["folder"])), lambda f: f["place"]))


def load_documents(spark: SparkSession, sources: str | list[str], **options) -> DataFrame:
    """The documents of ``load_sources``, for callers who do not look at what was lost."""
    return load_sources(spark, sources, **options).documents


def registered_documents(loaded: LoadedFiles) -> DataFrame:
    """The registry of a load: of documents with one id the last in the order of sources, else the last that was made."""
    order = F.struct("doc_seq", "created_at")
    return document_registry(loaded.documents.withColumn("_order", order), order_by="_order").drop("_order")


def fetched_pages(spark: SparkSession, addresses: list[tuple[int, str]], pages: DataFrame) -> DataFrame:
    """A row per request (place, address), with ``request``, its place; an address without a fetched page ends the job.

    Pages are taken once per address, so neither an address asked for twice nor a page fetched twice multiplies the
    other. Of different pages of one address the one with the least hash is taken, so that reruns agree.
    """
    wanted = spark.createDataFrame(addresses, "request int, url string")
    asked = wanted.select("url").distinct()
    first = Window.partitionBy("url").orderBy("_hash", "html")
    met = pages.select("url", "html", F.xxhash64("html").alias("_hash")).join(asked, "url", "left_semi")
    fetched = met.withColumn("_place", F.row_number().over(first)).where("_place = 1").drop("_place", "_hash")
    found = wanted.join(fetched, "url", "left")
    missing = F.raise_error(F.concat(F.lit("failed to load URL: "), F.col("url"))).cast("string")
    return found.withColumn("html", F.coalesce("html", missing))


def load_tables(
    files: DataFrame | None = None,
    pages: DataFrame | None = None,
    *,
    doc_types: list[str] | None = None,
    loader: FileLoader | None = None,
) -> DataFrame:
    """Documents of file rows (path, modificationTime, length, content) and page rows (url, html)."""
    frames, types = [], _file_types(doc_types)
    if files is not None and types:
        # told by the path, before anything is decoded; readers of other types stay out of the plan
        local = files.where(~urls.is_url(F.col("path")))
        if doc_types is not None:
            local = local.where(urls.document_type(F.col("path")).isin(*types))
        frames.append((loader or FileLoader()).load(local, types=types).documents)
    if pages is not None and (doc_types is None or "url" in doc_types):
        frames.append(web_documents(pages))
    if not frames:
        return (files if files is not None else pages).sparkSession.createDataFrame([], schemas.DOCUMENT)
    return filter_doc_types(reduce(DataFrame.unionByName, frames), doc_types)
