"""A corpus store of Parquet files: versions, incremental sync, prune, checks and compaction.

A version is one JSON file that names everything readers need: a table of sources (a row per
file) and the segments of chunks, pages, postings and embeddings. A sync writes what changed into a new
segment, a new table of sources (small beside the text) and, last of all, the version's file; until
then readers see the old one. Versions are numbered, and a version's file is created only where there is
none: of two writers that began from the same version the later one fails and has changed nothing. A
chunk is live if its source's row names its segment, so that replacing or dropping a source rewrites no
chunk. Postings are written once for each segment, and search reads those of its terms.

A sync takes files in with one pass that writes chunks and pages side by side (``taken``). A page's text stands there in the
column of bodies, right after those of its source, so that compression finds it again; a posting names its chunk, the chunk's
source and its length in one string (``doc``). Texts are shuffled only
where more than ``FEW`` rows have to be found among them, which are broadcast otherwise, or for sources that changed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.functions import text as X
from folioscan.operators import chunking, diff, lexical, maintenance, postings, vectors
from folioscan.sources import units as U

SCHEMAS = {
    "sources": "source_id string, path string, source_type string, sha256 string, versions string, segment string",
    "chunks": "chunk_id string, source_id string, segment string, ordinal int, logical_key string, content_type string, heading_path array<string>, body string, line_start int, line_end int, locator array<string>, lexical_hash string, semantic_hash string",
    "embeddings": "semantic_hash string, model string, vector array<float>",
    "pages": "source_id string, segment string, page int, text string",
    "postings": "chunk_id string, term string, tf bigint, positions array<int>, length int, source_id string, segment string",
    "failures": "path string, error string",
}
TAKEN = f"{SCHEMAS['chunks']}, path string, source_type string, sha256 string, error string, page int"
#: Further columns of the files of a table, of which ``_segment`` makes its own; files of version 1 have its own ones.
STORED = {"pages": "body string", "postings": "doc string"}
#: So many rows of a source's or chunk's id (some 100 MB) are sent to where the texts are.
FEW = 600_000
_CHUNK = "struct<ordinal:int,logical_key:string,content_type:string,heading_path:array<string>,body:string,line_start:int,line_end:int,locator:array<string>>"
VERSION, READ = 2, (1, 2)
CHUNKER = "chunks-1"


class StoreError(RuntimeError):
    """A store that is missing, unknown or incomplete."""


def stub_embedder(body: str) -> Column:
    """The deterministic embedder, for tests and for stores without a model."""
    return vectors.embed_stub(body)


@dataclass
class Options:
    """What a chunk depends on besides its source; ``full`` parses everything anew, ``reembed`` embeds all anew."""

    max_chars: int = chunking.MAX_CHARS
    model: str = "stub@1"
    full: bool = False
    reembed: bool = False

    @property
    def versions(self) -> str:
        return f"{CHUNKER}/{self.max_chars}"


@dataclass
class Report:
    """Counts of a sync."""

    added: int = 0
    changed: int = 0
    renamed: int = 0
    unchanged: int = 0
    missing: int = 0
    failed: int = 0
    chunks_inserted: int = 0
    chunks_updated: int = 0
    chunks_kept: int = 0
    chunks_deleted: int = 0
    embedded: int = 0
    version: str | None = None
    #: A few of the files that failed, for people; ``failures`` names the table of all.
    errors: list[str] = field(default_factory=list)
    failures: str | None = None

    def to_dict(self) -> dict:
        return asdict(self)


class Store:
    """A store at ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, create: bool = False):
        self.spark, self.root = spark, root.rstrip("/")
        self.state = self._load()
        if self.state is None:
            if not create:
                raise StoreError(f"no store at {root}")
            self.state = {"store": VERSION, "number": 0, "version": None, "sources": None, "chunks": [], "pages": [], "postings": [], "embeddings": [], "models": {}, "active": None}
        elif self.state.get("store") not in READ:
            raise StoreError(f"store format {self.state.get('store')} isn't known")

    # files ------------------------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _load(self) -> dict | None:
        """The newest version. ``CURRENT`` is only a hint where to begin; the numbered files decide."""
        fs, folder = self._fs(f"{self.root}/versions")
        if not fs.exists(folder):
            hint, p = self._fs(f"{self.root}/CURRENT")
            return json.loads(self.spark.read.text(f"{self.root}/CURRENT", wholetext=True).first()[0]) if hint.exists(p) else None
        names = sorted(f.getPath().getName() for f in fs.listStatus(folder) if f.getPath().getName().endswith(".json"))
        return json.loads(self.spark.read.text(f"{self.root}/versions/{names[-1]}", wholetext=True).first()[0]) if names else None

    def _publish(self, state: dict) -> None:
        """Add the next version's file, complete from the moment that it has its name; fail where another writer was first."""
        state = state | {"store": VERSION, "number": self.state.get("number", 0) + 1}
        fs, final = self._fs(f"{self.root}/versions/{state['number']:012d}.json")
        _, tmp = self._fs(f"{self.root}/versions/.{uuid.uuid4().hex}")
        out = fs.create(tmp, False)
        out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE  # never over a file that is there
        try:
            context.rename(tmp, final, options)
        except Exception as e:
            fs.delete(tmp, False)
            raise StoreError(f"version {state['number']} was published by another writer meanwhile; nothing was changed") from e
        self.state = state

    def _segment(self, name: str, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[name])
        schema = ", ".join([SCHEMAS[name], *([STORED[name]] if name in STORED else [])])
        df = self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in paths])
        if name == "pages":
            return df.withColumn("text", F.coalesce("text", "body")).drop("body")
        if name == "postings":
            part = F.split("doc", "\u001f")
            return df.withColumns({"chunk_id": F.coalesce("chunk_id", part[0]), "source_id": F.coalesce("source_id", part[1]), "length": F.coalesce("length", part[2].cast("int"))}).drop("doc")
        return df

    def _write(self, df: DataFrame, path: str) -> None:
        df.write.option("compression", "zstd").parquet(path)

    def _drop(self, *paths: str) -> None:
        for path in paths:
            fs, p = self._fs(path)
            fs.delete(p, True)

    def _alive(self, name: str, *columns: str) -> DataFrame:
        """Rows of a table whose source's row names their segment, with these columns of the source."""
        live = self.sources().select("source_id", "segment", *columns)
        few = live.limit(FEW + 1).count() <= FEW
        how = "inner" if columns else "left_semi"
        return self._segment(name, self.state.get(name, [])).join(F.broadcast(live) if few else live, ["source_id", "segment"], how)

    # tables ------------------------------------------------------------------------------

    def sources(self) -> DataFrame:
        return self._segment("sources", [self.state["sources"]] if self.state["sources"] else [])

    def chunks(self) -> DataFrame:
        """Live chunks with the path and type of their source."""
        return self._alive("chunks", "path", "source_type").filter("chunk_id is not null")

    def pages(self) -> DataFrame:
        """(source_id, segment, page, text, path, source_type) of live sources."""
        return self._alive("pages", "path", "source_type").filter("page is not null")

    def postings(self) -> DataFrame:
        """Postings of live chunks."""
        return self._alive("postings")

    def embeddings(self, model: str | None = None) -> DataFrame:
        e = self._segment("embeddings", self.state["embeddings"])
        return e if model is None else e.filter(F.col("model") == model)

    # changes -----------------------------------------------------------------------------

    def sync(self, files: DataFrame, options: Options | None = None, embed: Callable[[str], Column] = stub_embedder, partial: bool = False) -> Report:
        """Bring the store up to (path, content) of ``files``; with ``partial`` files that aren't among them say nothing.

        Files that vanished are reported as missing and stay until pruned. A file whose content
        turns up under one new path is renamed: neither parsed nor embedded again. A file that
        can't be parsed, or that changes while it is read, keeps what the store has of it and is reported. With nothing
        to take in, no chunk is read. Where another writer publishes meanwhile, StoreError is raised and nothing has changed.
        """
        options, r = options or Options(), Report()
        version = uuid.uuid4().hex
        spark, base = self.spark, f"{self.root}/v={version}"
        have = self.sources()
        seen_path = f"{base}/seen"
        files.select("path", F.sha2("content", 256).alias("sha256")).write.parquet(seen_path)
        seen = spark.read.parquet(seen_path)
        pairs = diff.rename_pairs(have.select("path", "sha256"), seen) if not partial else spark.createDataFrame([], "old_path string, new_path string, sha256 string")
        moved = have.join(pairs.select(F.col("old_path").alias("path"), "new_path"), "path", "left")
        now = moved.select("source_id", F.coalesce("new_path", "path").alias("path"), "source_type", "sha256", "versions", "segment", F.col("new_path").isNotNull().alias("renamed"))
        joined = seen.select("path", F.col("sha256").alias("new_sha")).join(now, "path", "full_outer")
        stale = (F.col("new_sha") != F.col("sha256")) | (F.col("versions") != options.versions) | F.lit(options.full)
        state = F.when(F.col("new_sha").isNull(), F.lit("kept" if partial else "missing")).when(F.col("sha256").isNull(), "added").when(stale, "changed").when(F.col("renamed"), "renamed").otherwise("unchanged")
        joined.select("*", state.alias("state")).write.parquet(f"{base}/plan")
        plan = spark.read.parquet(f"{base}/plan")
        for row in plan.groupBy("state").count().collect():  # five states at most
            if hasattr(r, row["state"]):
                setattr(r, row["state"], row["count"])

        source_id = F.coalesce("source_id", F.sha2(F.concat_ws("\u001f", F.lit(version), "path"), 256))
        todo = plan.filter("state in ('added', 'changed')").select("path", source_id.alias("source_id"), "state")
        n_todo, touched = r.added + r.changed, r.added + r.changed > 0
        few = lambda df, n: F.broadcast(df) if n <= FEW else df
        wanted = files.select("path", "content")
        if r.changed or n_todo < r.added + r.changed + r.renamed + r.unchanged:
            wanted = wanted.join(few(todo.select("path", "source_id"), n_todo), "path")
        else:  # all are new
            wanted = wanted.withColumn("source_id", F.sha2(F.concat_ws("\u001f", F.lit(version), "path"), 256))
        old = self.chunks().join(todo.filter("state = 'changed'").select("source_id"), "source_id", "left_semi")
        if touched:
            self._write(_taken(U.parse_files(wanted.withColumn("pages", U.page_texts())), options.max_chars, version), f"{base}/taken")
        taken = spark.read.schema(TAKEN).parquet(f"{base}/taken") if touched else spark.createDataFrame([], TAKEN)
        # a file that changed between its hash and its reading is not taken in with either
        read = taken.filter("sha256 is not null").select("path", "source_id", "source_type", "sha256", "error").join(seen.select("path", F.col("sha256").alias("seen_sha")), "path")
        read = read.withColumn("error", F.when(F.col("sha256") != F.col("seen_sha"), "changed while it was read").otherwise(F.col("error")))
        bad, good = read.filter("error is not null"), read.filter("error is null")
        r.failed, torn = bad.agg(F.count(F.lit(1)), F.count_if(F.col("sha256") != F.col("seen_sha"))).first()
        if r.failed:
            r.failures = f"v={version}/failures"
            bad.select("path", "error").write.parquet(f"{self.root}/{r.failures}")
        r.errors = [f"{x['path']}: {x['error'][:500]}" for x in bad.orderBy("path").limit(20).collect()] if r.failed else []

        columns = lambda name: [c.split()[0] for c in SCHEMAS[name].split(", ")]
        fresh, whole = taken.filter("chunk_id is not null").select(*columns("chunks")), taken.filter("page is not null").withColumn("text", F.col("body")).select(*columns("pages"))
        if torn:
            torn_ids = few(bad.select("source_id"), r.failed)
            fresh, whole = fresh.join(torn_ids, "source_id", "left_anti"), whole.join(torn_ids, "source_id", "left_anti")
        parts = {"chunks": "taken", "pages": "taken"}
        if r.changed:
            side = lambda df: df.select(F.col("source_id").alias("source"), "logical_key", "ordinal", "semantic_hash")
            old = old.join(good.select("source_id"), "source_id", "left_semi")
            diff.chunk_diff(side(old), side(fresh)).write.parquet(f"{base}/diff")
            actions = spark.read.parquet(f"{base}/diff")
            for row in actions.groupBy("action").count().collect():
                name = {"insert": "chunks_inserted", "update": "chunks_updated", "keep": "chunks_kept", "move": "chunks_kept", "delete": "chunks_deleted"}[row["action"]]
                setattr(r, name, getattr(r, name) + row["count"])
            kept = actions.filter("old_ordinal is not null and new_ordinal is not null").select(F.col("source").alias("source_id"), "old_ordinal", F.col("new_ordinal").alias("ordinal"))
            kept = kept.join(old.select("source_id", F.col("ordinal").alias("old_ordinal"), F.col("chunk_id").alias("old_id")), ["source_id", "old_ordinal"]).select("source_id", "ordinal", "old_id")
            fresh = fresh.join(few(kept, r.chunks_kept + r.chunks_updated), ["source_id", "ordinal"], "left").withColumn("chunk_id", F.coalesce("old_id", "chunk_id")).select(*columns("chunks"))
        elif touched:
            r.chunks_inserted = fresh.count()
        if r.changed or torn:
            self._write(fresh, f"{base}/chunks")
            self._write(whole, f"{base}/pages")
            parts = {"chunks": "chunks", "pages": "pages"}
        add = lambda name: [*self.state.get(name, []), *([f"v={version}/{parts.get(name, name)}"] if touched else [])]
        if touched:
            fresh_chunks = self._segment("chunks", [f"v={version}/{parts['chunks']}"]).filter("chunk_id is not null")
            self._index(fresh_chunks, f"{base}/postings", version)

        ok = good.select("source_id", F.lit(version).alias("fresh_segment"), F.col("source_type").alias("fresh_type"))
        after = plan.withColumn("source_id", source_id).join(ok, "source_id", "left")
        renewed = F.col("fresh_segment").isNotNull()
        after = after.select(
            "source_id", "path", F.coalesce("fresh_type", "source_type").alias("source_type"), F.when(renewed, F.col("new_sha")).otherwise(F.col("sha256")).alias("sha256"),
            F.when(renewed, F.lit(options.versions)).otherwise(F.col("versions")).alias("versions"), F.coalesce("fresh_segment", "segment").alias("segment"),
        ).filter("segment is not null")
        after.write.parquet(f"{base}/sources")

        draft = dict(self.state) | {"version": version, "sources": f"v={version}/sources", "chunks": add("chunks"), "pages": add("pages"), "postings": add("postings"), "active": options.model}
        before = self.state
        # what other segments need was embedded when they were written, unless the model is another one
        whole = options.reembed or before["active"] != options.model
        self.state = draft  # read below, and published only when all of it is there
        try:
            live = self.chunks() if whole else fresh_chunks if touched else None
            if live is not None:
                ids = live.select("semantic_hash", "chunk_id")
                spare = ids.withColumn("k", F.row_number().over(W.partitionBy("semantic_hash").orderBy("chunk_id"))).filter("k > 1")  # the first embeds for all that share the hash
                if not options.reembed and self.state["embeddings"]:
                    spare = spare.select("chunk_id").union(ids.join(self.embeddings(options.model).select("semantic_hash"), "semantic_hash", "left_semi").select("chunk_id"))
                self._write(spare.select("chunk_id").distinct(), f"{base}/spare")
                spare = spark.read.parquet(f"{base}/spare")
                lack = live.select("chunk_id", "semantic_hash", "body").join(few(spare, spare.count()), "chunk_id", "left_anti")
                lack.select("semantic_hash", F.lit(options.model).alias("model"), embed("body").alias("vector")).write.option("compression", "zstd").parquet(f"{base}/embeddings")
                r.embedded = spark.read.parquet(f"{base}/embeddings").count()
        finally:
            self.state = before
        self._drop(*[f"{base}/{x}" for x in ("seen", "plan", "diff", "spare", *(["taken"] if parts["chunks"] != "taken" else []))])
        embeddings = list(self.state["embeddings"])
        if options.reembed and r.embedded:
            self._segment("embeddings", embeddings).filter(F.col("model") != options.model).write.parquet(f"{base}/others")
            embeddings = [f"v={version}/others"]
        if r.embedded:
            embeddings.append(f"v={version}/embeddings")
        r.version = version
        if not (touched or r.renamed or r.embedded or before["active"] != options.model):
            r.version = before["version"]  # nothing to publish
            return r
        self._publish(draft | {"embeddings": embeddings})
        return r

    def _index(self, chunks: DataFrame, path: str, segment: str) -> None:
        """Postings of the chunks of a segment, over body and headings."""
        t = chunks.select("chunk_id", "source_id", lexical.tokens(F.concat_ws(" ", "body", F.array_join("heading_path", " "))).alias("t"))
        doc = F.concat_ws("\u001f", "chunk_id", "source_id", F.size("t").cast("string"))
        postings.write(postings.inverted(t.select(doc.alias("doc"), "t")).select("doc", "term", "tf", "positions", F.lit(segment).alias("segment")), path)

    def failures(self, report: Report) -> DataFrame:
        """(path, error) of every file that a sync could not take in."""
        return self._segment("failures", [report.failures] if report.failures else [])

    def statistics(self) -> DataFrame:
        """(n, tokens) of live chunks; chunks without any token count too."""
        return postings.totals(self.chunks(), self.postings())

    def prune_plan(self, keep: Column) -> DataFrame:
        """(source_id, path) of the sources that ``keep``, an expression on path, doesn't select."""
        return self.sources().filter(~F.coalesce(keep, F.lit(False))).select("source_id", "path")

    def prune(self, keep: Column) -> int:
        """Drop these sources; returns how many. Their chunks are dead at once, their files go with compaction."""
        gone = self.prune_plan(keep).count()
        if gone:
            version = uuid.uuid4().hex
            self.sources().filter(F.coalesce(keep, F.lit(False))).write.parquet(f"{self.root}/v={version}/sources")
            self._publish(dict(self.state) | {"version": version, "sources": f"v={version}/sources"})
        return gone

    def doctor(self) -> DataFrame:
        """(issue, key) of whatever is wrong; no rows for a sound store."""
        c, s = self.chunks(), self.sources()
        e = self.embeddings(self.state["active"])
        of = lambda df, issue, key: df.select(F.lit(issue).alias("issue"), F.col(key).cast("string").alias("key"))
        out = of(c.join(e.select("semantic_hash"), "semantic_hash", "left_anti"), "chunk-without-embedding", "chunk_id")
        out = out.union(of(c.groupBy("chunk_id").count().filter("count > 1"), "duplicate-chunk-id", "chunk_id"))
        out = out.union(of(s.groupBy("path").count().filter("count > 1"), "duplicate-path", "path"))
        out = out.union(of(e.groupBy("semantic_hash").count().filter("count > 1"), "duplicate-embedding", "semantic_hash"))
        out = out.union(of(c.filter(X.lexical_hash(F.col("body")) != F.col("lexical_hash")), "changed-body", "chunk_id"))
        return out.union(of(e.filter(F.exists("vector", lambda x: F.isnan(x)) | (F.size("vector") == 0)), "bad-vector", "semantic_hash"))

    def _prints(self) -> dict[str, tuple[int, ...]]:
        """Rows and fingerprint of each table that readers see. Where rows belong to sources, each task sums up its own by source before the live ones are chosen."""
        live, h = self.sources().select("source_id", "segment"), F.col("h")

        def of_live(name: str, *values: str | Column) -> tuple[int, ...]:
            rows = self._segment(name, self.state.get(name, [])).filter(F.col("page" if name == "pages" else "chunk_id").isNotNull()).select("source_id", "segment", F.xxhash64("source_id", *values).alias("h"))
            low, high = F.sum(h.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned(h, 32))
            sums = rows.groupBy("source_id", "segment").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), low.alias("low"), high.alias("high")).join(live, ["source_id", "segment"], "left_semi")
            return tuple(sums.agg(*[F.coalesce(c, F.lit(0)) for c in (F.sum("n"), F.bit_xor("x"), F.sum("low"), F.sum("high"))]).first())

        vectors_ = self.embeddings().select("semantic_hash", "model", F.xxhash64("vector").alias("h"))
        return {
            "chunks": of_live("chunks", "chunk_id", "lexical_hash", "semantic_hash"), "pages": of_live("pages", "page", "text"), "postings": of_live("postings", "chunk_id", "term", "tf", F.xxhash64("positions"), "length"),
            "sources": maintenance.fingerprint(self.sources().drop("segment")), "embeddings": maintenance.fingerprint(vectors_.join(self.chunks().select("semantic_hash").distinct(), "semantic_hash", "left_semi")),
        }

    def compact(self) -> dict[str, int]:
        """Rewrite live rows into one segment, without embeddings that no chunk has; published only if counts and fingerprints of all tables agree."""
        version = uuid.uuid4().hex
        base = f"{self.root}/v={version}"
        of = lambda name, df: df.withColumn("segment", F.lit(version)).select(*[c.split()[0] for c in SCHEMAS[name].split(", ")])
        self._write(of("chunks", self.chunks()), f"{base}/chunks")
        self._write(of("pages", self.pages()), f"{base}/pages")
        self._write(of("sources", self.sources()), f"{base}/sources")
        self._index(self._segment("chunks", [f"v={version}/chunks"]), f"{base}/postings", version)
        used = self.chunks().select("semantic_hash").distinct()
        self._write(self.embeddings().join(used, "semantic_hash", "left_semi"), f"{base}/embeddings")
        before = self._prints()
        old, draft = self.state, dict(self.state) | {"version": version, "sources": f"v={version}/sources"} | {k: [f"v={version}/{k}"] for k in ("chunks", "pages", "postings", "embeddings")}
        self.state = draft
        try:
            after = self._prints()
        finally:
            self.state = old
        if before != after:
            raise StoreError("the compacted copy differs; the store stays as it is")
        self._publish(draft)
        return {k: after[k][0] for k in ("chunks", "sources")}

    def vacuum(self) -> int:
        """Delete the version folders that the present version doesn't name; for when no reader has an older one open."""
        fs, root = self._fs(self.root)
        named = {p.split("/")[0] for p in [self.state["sources"], *[x for k in ("chunks", "pages", "postings", "embeddings") for x in self.state.get(k, [])]] if p}
        gone = 0
        for f in fs.listStatus(root):
            name = f.getPath().getName()
            if name.startswith("v=") and name not in named:
                fs.delete(f.getPath(), True)
                gone += 1
        return gone


def _taken(parsed: DataFrame, max_chars: int, version: str) -> DataFrame:
    """``TAKEN`` of (source_id, path, source_type, sha256, error, units, pages): a row for each chunk, for each page and for the file itself, which has its hash and error.

    Units go in order and are folded under the budget; a heading path of its own begins a chunk. Nothing is shuffled.
    """
    sizes, paths = F.transform("units", lambda u: F.length(u["text"])), F.transform("units", lambda u: F.array_join(u["heading_path"], "\u001f"))

    def chunk(x, i):
        us = F.slice(F.col("units"), x["start"] + 1, x["n"])
        kinds = F.array_distinct(F.transform(us, lambda u: u["content_type"]))
        body = F.array_join(F.transform(us, lambda u: u["text"]), "\n\n")
        return F.struct(
            i.alias("ordinal"), us[0]["logical_key"].alias("logical_key"), F.when(F.size(kinds) == 1, kinds[0]).otherwise("mixed").alias("content_type"), us[0]["heading_path"].alias("heading_path"), body.alias("body"),
            F.array_min(F.transform(us, lambda u: u["line_start"])).alias("line_start"), F.array_max(F.transform(us, lambda u: u["line_end"])).alias("line_end"), F.filter(F.transform(us, lambda u: u["locator"]), lambda x: x.isNotNull()).alias("locator"),
        )

    rows = F.struct
    chunk_rows = F.transform(F.transform("__g", chunk), lambda c: rows(c.alias("c"), F.lit(None).cast("struct<page:int,text:string>").alias("p")))
    page_rows = F.transform("pages", lambda p: rows(F.lit(None).cast(_CHUNK).alias("c"), p.alias("p")))
    file_row = F.array(rows(F.lit(None).cast(_CHUNK).alias("c"), F.lit(None).cast("struct<page:int,text:string>").alias("p")))
    g = parsed.withColumn("__g", chunking.groups(sizes, paths, max_chars))
    x = g.select("source_id", "path", "source_type", "sha256", "error", F.explode(F.concat(chunk_rows, page_rows, file_row)).alias("x")).select("source_id", "path", "source_type", "sha256", "error", "x.c.*", "x.p.*")
    x = x.withColumn("body", F.coalesce("body", "text")).drop("text")
    is_chunk, is_file = F.col("ordinal").isNotNull(), F.col("ordinal").isNull() & F.col("page").isNull()
    only = lambda when, c: F.when(when, c)
    x = x.select(
        "*", only(is_chunk, F.sha2(F.concat_ws("\u001f", "source_id", "logical_key", F.col("ordinal").cast("string"), F.lit(version)), 256)).alias("chunk_id"), F.lit(version).alias("segment"),
        only(is_chunk, X.lexical_hash(F.col("body"))).alias("lexical_hash"), only(is_chunk, X.semantic_hash(CHUNKER, F.col("source_type"), F.to_json("heading_path"), F.col("body"))).alias("semantic_hash"),
    )
    alone = {c: only(is_file, F.col(c)) for c in ("path", "sha256", "error")}
    return x.withColumns(alone).select(*[c.split()[0] for c in TAKEN.split(", ")])
