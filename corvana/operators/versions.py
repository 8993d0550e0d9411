"""Tables that change together: new data first, one manifest last.

A store is a folder. A table in it is a set of buckets by the hash of its key, each a folder of Parquet files that never change.
A commit writes the buckets that it touches to new folders and then puts one manifest beside the others, whose number is the
next; who reads takes the highest. Until that last step, an atomic rename that fails where the number is taken, all readers see
the state before, whatever was written. So a commit over several tables is whole or not at all, and of two writers that began
at the same state one is told to begin again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


class Conflict(RuntimeError):
    """Another commit came first."""


class Files:
    """A folder of small JSON files on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.path = self.jvm.org.apache.hadoop.fs.Path(folder)
        self.fs = self.path.getFileSystem(self.conf)

    def names(self) -> list[str]:
        if not self.fs.exists(self.path):
            return []
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.path))

    def read(self, name: str) -> dict:
        stream = self.fs.open(self.jvm.org.apache.hadoop.fs.Path(self.path, name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def put(self, name: str, content: dict) -> None:
        """All of it or nothing; Conflict if the name is there."""
        own = self.jvm.org.apache.hadoop.fs.Path(self.path, f".{uuid.uuid4().hex}")
        stream = self.fs.create(own, False)
        try:
            stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        finally:
            stream.close()
        fs = self.jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        strict = self.gateway.new_array(getattr(fs, "Options$Rename"), 0)
        try:
            context.rename(self.fs.makeQualified(own), self.fs.makeQualified(fs.Path(self.path, name)), strict)
        except Exception as error:
            self.fs.delete(own, False)
            raise Conflict(f"{name} is there already") from error


class Store:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.manifests, self.journal = Files(spark, f"{self.folder}/manifests"), Files(spark, f"{self.folder}/journal")

    def version(self) -> int:
        return max((int(n.removesuffix(".json")) for n in self.manifests.names() if n[:1] != "."), default=0)

    def state(self, version: int | None = None) -> dict:
        at = self.version() if version is None else version
        return self.manifests.read(f"{at:012d}.json") if at else {}

    def read(self, name: str, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """A table as the latest (or another) commit left it; of some buckets alone, if given."""
        table = self.state(version)[name]
        paths = [p for b, p in table["buckets"].items() if only is None or int(b) in only]
        schema = T.StructType.fromJson(table["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def bucket(self, key: str):
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.buckets)).cast("int")

    def write(self, name: str, rows: DataFrame, key: str) -> dict[str, str]:
        """rows by bucket in a new folder that no manifest names yet; the bucket's folder by its number. Each task writes its own part
        of a bucket, so no row travels for that, and no task holds a whole bucket."""
        folder = f"{self.folder}/data/{name}/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self.bucket(key)).write.partitionBy("_bucket").option("compression", "zstd").parquet(folder)
        made = Files(self.spark, folder).names()
        return {n.partition("=")[2]: f"{folder}/{n}" for n in made if n.startswith("_bucket=")}

    def commit(self, tables: dict[str, tuple[DataFrame, str]], touched: dict[str, list[int]] | None = None, since: int | None = None, note: str = "") -> int:
        """The number of the state with these tables (name: rows and key), the others as they were. `touched` names the buckets
        that a table's rows replace; a table that it does not name is replaced whole. Conflict if there was a commit after
        `since`."""
        at = self.version() if since is None else since
        state = self.state(at)
        for name, (rows, key) in tables.items():
            written = self.write(name, rows, key)
            kept = {}
            if touched and name in touched and name in state:
                kept = {b: p for b, p in state[name]["buckets"].items() if int(b) not in touched[name]}
            state[name] = {"schema": json.loads(rows.schema.json()), "key": key, "buckets": kept | written}
        self.publish(at + 1, state | {"_note": note})
        return at + 1

    def publish(self, number: int, state: dict) -> None:
        self.manifests.put(f"{number:012d}.json", state)

    def touched(self, rows: DataFrame, key: str) -> list[int]:
        return [r[0] for r in rows.select(self.bucket(key)).distinct().collect()]  # `buckets` numbers at most


def replace_documents(store: Store, found: DataFrame, children: DataFrame, shared: DataFrame) -> DataFrame:
    """Scan results over a store's documents, occurrences and shared hash rows, in one commit; returns the documents that were new
    or changed.

    found(source_path, sha, mtime, status, ..) and children(source_path, ..) are of files that were scanned; a file whose hash and
    time are known and whose row is `scanned` needs nothing. The row of a changed file goes with all its children, and the new
    ones come; of shared(hash, ..) known hashes are overwritten and others added. Only buckets with such keys are read or
    written. With no change there is no commit."""
    since = store.version()
    names = {"documents": (found, "source_path"), "occurrences": (children, "source_path"), "shared": (shared, "hash")}
    if not since:
        store.commit({n: (rows.limit(0), key) for n, (rows, key) in names.items()})
        since = 1
    by = ["source_path", "sha", "mtime"]
    same = store.read("documents", since).where("status = 'scanned'").select(*by)
    changed = found.join(same, by, "left_anti")
    paths = changed.select("source_path").distinct()
    touched = store.touched(paths, "source_path")
    if not touched:
        return changed
    news = {"documents": changed, "occurrences": children.join(paths, "source_path", "left_semi"), "shared": shared}
    tables, where = {}, {}
    for name, rows in news.items():
        key = names[name][1]
        where[name] = touched if key == "source_path" else store.touched(rows, key)
        gone = paths if key == "source_path" else rows.select(key)
        old = store.read(name, since, where[name]).join(gone, key, "left_anti")
        tables[name] = (old.unionByName(rows), key)
    store.commit(tables, where, since, "documents")
    return changed


def apply_decisions(store: Store, audit: str, supplied: DataFrame) -> int:
    """An audit's decisions (key, sha, status) over a store's previews(audit, key, sha, status), results(key, final_status, ..) and
    occurrences(source_path, key, status, ..), in one commit. ValueError, and nothing changes, unless the supplied (key, sha) are
    exactly the audit's. Decisions become the previews' status and the results' final status, and the status of the occurrences
    whose key is among them."""
    since = store.version()
    previews = store.read("previews", since)
    own = previews.where(F.col("audit") == audit).select("key", F.col("sha").alias("_sha"))
    both = own.join(supplied.select("key", "sha"), "key", "full")
    if not both.where(~F.coalesce(F.col("_sha") == F.col("sha"), F.lit(False))).isEmpty() or supplied.groupBy("key").count().where("count > 1").count():
        raise ValueError(f"the decisions are not those that audit {audit} asks for")
    told = supplied.select("key", F.col("status").alias("_new"))

    def over(rows: DataFrame, column: str, only=None) -> DataFrame:
        joined = rows.join(told, "key", "left")
        new = F.coalesce("_new" if only is None else F.when(only, F.col("_new")), column)
        return joined.select(*(new.alias(c) if c == column else F.col(c) for c in rows.columns))

    results = store.read("results", since)
    added = told.join(results, "key", "left_anti").select("key", F.col("_new").alias("final_status"))
    tables = {
        "previews": (over(previews, "status", F.col("audit") == audit), "key"),
        "results": (over(results, "final_status").unionByName(added, allowMissingColumns=True), "key"),
        "occurrences": (over(store.read("occurrences", since), "status"), "source_path"),
    }
    return store.commit(tables, since=since, note=f"audit {audit}")


def cutover(store: Store, name: str, tables: dict[str, tuple[DataFrame, str]], change: str) -> int:
    """A migration by journal: what is to be is written and recorded as prepared, then published, then recorded as committed. A
    change that is committed is not done again; one that was only prepared is finished by `replay` from what was written."""
    if f"{change}.committed.json" in store.journal.names():
        return store.journal.read(f"{change}.committed.json")["version"]
    if f"{change}.prepared.json" not in store.journal.names():
        at = store.version()
        state = store.state(at)
        for table, (rows, key) in tables.items():
            state[table] = {"schema": json.loads(rows.schema.json()), "key": key, "buckets": store.write(table, rows, key)}
        store.journal.put(f"{change}.prepared.json", {"since": at, "name": name, "state": state | {"_note": change}})
    return replay(store)[change]


def replay(store: Store) -> dict[str, int]:
    """Finish what the journal has as prepared; the versions of all changes by name. Conflict, and nothing changes, where another
    commit came between."""
    names = store.journal.names()
    done = {}
    for entry in (n for n in names if n.endswith(".prepared.json")):
        change = entry.removesuffix(".prepared.json")
        if f"{change}.committed.json" in names:
            done[change] = store.journal.read(f"{change}.committed.json")["version"]
            continue
        plan = store.journal.read(entry)
        number = plan["since"] + 1
        if store.version() < number:
            store.publish(number, plan["state"])
        elif store.state(number).get("_note") != change:
            raise Conflict(f"{change} was prepared before version {number}")
        store.journal.put(f"{change}.committed.json", {"version": number})
        done[change] = number
    return done
