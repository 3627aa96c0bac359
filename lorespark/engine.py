"""The public surface: collections, uploads, builds, search and citations over one root folder.

``<root>/<collection>/store`` holds the tables ``sources`` (uploads as they came), ``documents`` and ``chunks`` with the collection's record under one commit log
(``sources.store``): a build's chunks and its documents' states appear together, and an upload or a removal beside a running build stays. ``log`` is what builds said.
What a caller does wrong comes back as data (``ok``, ``reason``), it isn't raised by ``search``.
"""

from __future__ import annotations

import re
import threading
import uuid
from datetime import datetime, timezone

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.functions import text as T
from lorespark.operators import catalog, chunking, convert, embed, evidence, inverted, lines, retrieval
from lorespark.sources import files as stored_files
from lorespark.sources import snapshots
from lorespark.sources.store import Conflict, Store, Transaction

TOKENIZER = "words-and-pairs-1"
DEFAULTS = {"min_score": 0.55, "topk": 8, "candidates": 100, "mode": "hybrid"}
LIMITS = {"min_score": (0.0, 1.0), "topk": (1, 50), "candidates": (20, 1000)}
#: Classes for each doubling of a size that a running sum over documents is taken by.
PARTS = 16
#: What a build does after the other, and the share of its progress that each is taken for.
PHASES = {"chunks": (0.02, 0.6), "index": (0.6, 0.9), "documents": (0.9, 0.99)}
#: Times that a build begins again after another one replaced what it worked on.
BUILD_ATTEMPTS = 3
ID = re.compile(r"^kb_[a-z][a-z0-9]{0,15}_[0-9a-f]{4}$")


def effective(*layers: dict) -> dict:
    """Settings of the first layer that has each, down to the defaults."""
    return {k: next((x[k] for x in layers if x.get(k) is not None), v) for k, v in DEFAULTS.items()}


def validated(settings: dict) -> dict:
    for k, v in settings.items():
        if k == "mode":
            if v not in ("hybrid", "dense"):
                raise ValueError("mode is hybrid or dense")
        elif k not in LIMITS:
            raise ValueError(f"unknown setting {k}")
        elif not LIMITS[k][0] <= v <= LIMITS[k][1]:
            raise ValueError(f"{k} must be within {LIMITS[k][0]} and {LIMITS[k][1]}")
    return settings


def _indexed(chunks: DataFrame) -> DataFrame:
    """Chunks as the text index takes them."""
    return chunks.select(F.col("chunk_id").alias("id"), F.col("doc_id").alias("owner"), "text")


class KnowledgeBase:
    def __init__(self, spark: SparkSession, root: str, embedder: embed.EmbedFn = embed.bigram_embedder, dimension: int = embed.DIMENSION, quota: int | None = None):
        self.spark, self.root, self.embedder, self.dimension, self.quota = spark, root.rstrip("/"), embedder, dimension, quota
        self._jobs: dict[str, dict] = {}

    # Catalog

    def _at(self, collection: str, what: str = "") -> str:
        if not ID.match(collection):
            raise ValueError(f"{collection!r} isn't a collection's id")
        return f"{self.root}/{collection}" + (f"/{what}" if what else "")

    def _store(self, collection: str) -> Store:
        return Store(self.spark, self._at(collection, "store"))

    def _meta(self, collection: str) -> dict | None:
        return self._store(collection).meta or None

    def _save(self, collection: str, **meta) -> dict:
        t = self._store(collection).begin()
        return t.commit(**meta)["meta"]

    @staticmethod
    def _now() -> str:
        return datetime.now(timezone.utc).isoformat()

    def create(self, name: str, description: str = "") -> str:
        made = self.spark.range(1).select(T.collection_id(F.lit(name)).alias("id")).first()["id"]
        if self._meta(made):
            raise ValueError(f"{made} exists already")
        self._save(made, id=made, name=name, description=description, created_at=self._now(), built_at=None, settings={})
        return made

    def rename(self, collection: str, name: str) -> dict:
        self._known(collection)
        return self._save(collection, name=name)

    def delete(self, collection: str) -> None:
        fs, path = snapshots._fs(self.spark, self._at(collection))
        fs.delete(path, True)

    def _known(self, collection: str) -> dict:
        found = self._meta(collection)
        if not found:
            raise KeyError(f"there is no collection {collection}")
        return found

    def ids(self) -> list[str]:
        fs, path = snapshots._fs(self.spark, self.root)
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n for n in names if ID.match(n) and fs.exists(snapshots._fs(self.spark, self._at(n, "store/commits"))[1]))

    def _metas(self) -> list[dict]:
        """The records of all collections: a small file for each."""
        return [self._meta(n) for n in self.ids()]

    def collections(self) -> DataFrame:
        """(collection, name, description, created_at, built_at), the latest first."""
        rows = [(m["id"], m["name"], m["description"], m["created_at"], m["built_at"]) for m in self._metas()]
        return self.spark.createDataFrame(rows, "collection string, name string, description string, created_at string, built_at string").orderBy(F.desc("created_at"), "collection")

    def overview(self) -> DataFrame:
        """Collections with counts of their documents and a status."""
        every = [self.documents(c).withColumn("collection", F.lit(c)) for c in self.ids()]
        docs = every[0] if every else self.spark.createDataFrame([], "collection string, status string, chunks long")
        for d in every[1:]:
            docs = docs.unionByName(d)
        return catalog.view(self.collections(), catalog.summary(docs))

    def builds(self) -> DataFrame:
        """Collections that were ever built, the latest first."""
        return catalog.build_records(self.overview())

    def embedding_info(self) -> dict:
        return {"dimension": self.dimension, "embedder": getattr(self.embedder, "__name__", type(self.embedder).__name__)}

    @staticmethod
    def quantizer_options() -> list[dict]:
        """Each quantizer with the bytes that a component takes and its compression."""
        return [{"value": k, "bytes": v, "compression": 4 / v} for k, v in catalog.QUANTIZERS.items()]

    # Documents

    _DOCUMENT = "doc_id string, name string, text string, bytes long, status string, chunks long, structure string, converter string, error string, at string"

    def documents(self, collection: str) -> DataFrame:
        self._known(collection)
        found = self._store(collection).read("documents")
        return self.spark.createDataFrame([], self._DOCUMENT) if found is None else found

    def chunks(self, collection: str) -> DataFrame | None:
        """The chunks that are served; None before the first build."""
        return self._store(collection).read("chunks")

    def list_documents(self, collection: str, status: str = "all", text: str = "") -> DataFrame:
        """Documents without their texts, the largest id first; of one status, or whose name holds a text."""
        return catalog.document_list(catalog.matching(self.documents(collection), status, text))

    def chunk_count(self, collection: str, doc_id: str) -> int:
        """How many chunks of a document are served."""
        chunks = self._store(collection).read("chunks", keys=[doc_id])
        return 0 if chunks is None else chunks.count()

    def add(self, collection: str, files: DataFrame) -> DataFrame:
        """Takes files (name, content); gives (name, doc_id, reason), reason null for those taken. Converted texts are kept, bad documents are kept as failed.

        A name may repeat: each file is a document of its own. A document whose text no longer fits the quota is kept as failed, without the text.
        """
        self._known(collection)
        size, now = F.octet_length("content"), self._now()
        judged = files.select("name", "content", size.cast("long").alias("bytes"), catalog.upload_verdict("name", size).alias("reason"))
        #: Written once, so that each row keeps its number.
        rows = snapshots.kept(judged.withColumn("_row", F.monotonically_increasing_id()), "upload")
        place = F.row_number().over(Window.partitionBy("name").orderBy("_row"))
        seed = F.concat(F.lit(now), F.when(F.col("_place") > 1, F.concat(F.lit("#"), F.col("_place").cast("string"))).otherwise(""))
        usual = F.when(F.col("reason").isNull(), T.fnv1a_id("name", F.lit(now)))
        named = rows.select("_row", "name", "reason", place.alias("_place")).select("_row", usual.alias("_usual"), F.when(F.col("reason").isNull(), T.fnv1a_id("name", seed)).alias("doc_id"))
        t = self._store(collection).begin()
        #: Names repeat and hashes meet seldom: those rows alone are kept, and where they are few no content is shuffled for its id.
        named = snapshots.kept(self._apart(named, t.read("documents")).where("doc_id <> _usual").select("_row", F.col("doc_id").alias("_other")), "ids")
        rows = rows.join(named, "_row", "left").withColumn("doc_id", F.coalesce("_other", usual)).drop("_other")
        judged = rows.select("name", "doc_id", "reason")
        if self.quota is not None:
            incoming = rows.where("reason is null").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"]
            used = self.usage(collection).first()["used"]
            if used + incoming > self.quota:
                return judged.select("name", F.lit(None).cast("string").alias("doc_id"), F.coalesce("reason", F.lit(f"over the quota by {used + incoming - self.quota} bytes")).alias("reason"))
        taken = rows.where("reason is null").select("doc_id", "name", "bytes", "content", F.lit(now).alias("at"))
        t.append("sources", taken, "doc_id")
        t.append("documents", self._admitted(self._parsed(t.written("sources")), t), "doc_id", dealt="ordered")
        t.commit()
        return judged

    @staticmethod
    def _apart(named: DataFrame, known: DataFrame | None) -> DataFrame:
        """Rows (_row, doc_id) whose ids differ from each other and from those of ``known`` documents.

        Ids have 32 bits of a hash, which names share from some 100,000 on: the first document keeps the hash, later ones add ``-2`` and so on.
        """
        own = F.coalesce("doc_id", F.col("_row").cast("string"))  # rows that weren't taken have no id
        place = F.row_number().over(Window.partitionBy(own).orderBy("_row"))
        rows = named.withColumn("_place", place)
        if known is not None:
            there = known.groupBy(F.substring_index("doc_id", "-", 1).alias("doc_id")).agg(F.max(F.coalesce(F.regexp_extract("doc_id", "-([0-9]+)$", 1).try_cast("int"), F.lit(1))).alias("_last"))
            rows = rows.join(there, "doc_id", "left").withColumn("_place", F.col("_place") + F.coalesce("_last", F.lit(0))).drop("_last")
        return rows.withColumn("doc_id", F.when(F.col("_place") > 1, F.concat("doc_id", F.lit("-"), F.col("_place").cast("string"))).otherwise(F.col("doc_id"))).drop("_place")

    def _admitted(self, parsed: DataFrame, t) -> DataFrame:
        """Parsed documents; where their texts don't fit beside what is stored, the largest become failed, so that as many as can stay."""
        if self.quota is None:
            return parsed
        parsed, known = snapshots.kept(parsed, "parsed"), t.read("documents")
        used = 0 if known is None else catalog.quota(known, self.quota).first()["used"]
        total = parsed.agg(F.coalesce(F.sum(F.greatest(F.octet_length("text"), F.col("bytes"))), F.lit(0)).alias("n")).first()["n"]
        if used + total <= self.quota:
            return parsed
        #: From the smallest on; the running sum goes over classes of sizes: within each class, and over the classes' totals.
        sizes = parsed.select("doc_id", F.greatest(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), "bytes").alias("n")).withColumn("_part", F.floor(F.log2(F.col("n") + 1) * PARTS).cast("int"))
        within = sizes.withColumn("_within", F.sum("n").over(Window.partitionBy("_part").orderBy("n", "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
        parts = sizes.groupBy("_part").agg(F.sum("n").alias("n"))
        before = parts.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
        upto = within.join(F.broadcast(before), "_part").select("doc_id", (F.col("_within") + F.col("_before")).alias("_upto"))
        fits = F.col("_upto") + used <= self.quota
        out = parsed.join(upto, "doc_id")
        out = out.withColumns({"error": F.when(fits, F.col("error")).otherwise("its text is over the quota"), "status": F.when(fits, F.col("status")).otherwise("failed"), "text": F.when(fits, F.col("text"))})
        return out.select(*parsed.columns)

    @staticmethod
    def _parsed(taken: DataFrame) -> DataFrame:
        """Document records of files (doc_id, name, bytes, content, at)."""
        #: What is known of a file goes before its name as folders, so that files of one name keep apart and texts meet their facts without a shuffle.
        facts = F.concat_ws("/", "doc_id", F.coalesce(F.col("bytes").cast("string"), F.lit("")), F.coalesce("at", F.lit("")), F.col("name").isNull().cast("string"), F.coalesce("name", F.lit("")))
        part = F.split("name", "/", 5)
        text = convert.convert_files(taken.select(facts.alias("name"), "content")).withColumn("_f", part)
        text = text.withColumns({
            "doc_id": F.col("_f")[0], "bytes": F.col("_f")[1].try_cast("long"), "at": F.when(F.col("_f")[2] != "", F.col("_f")[2]), "name": F.when(F.col("_f")[3] == "false", F.col("_f")[4]),
        })
        return text.select(
            "doc_id", "name", "text", "bytes", F.when(F.col("failed"), "failed").otherwise("pending").alias("status"), F.lit(None).cast("long").alias("chunks"),
            "structure", F.when(T.format_of("name") != "verbatim", T.format_of("name")).alias("converter"), "error", "at",
        )

    def remove(self, collection: str, doc_ids: list[str] | DataFrame) -> None:
        """Takes documents (their ids, or a frame with doc_id), their uploads and their chunks out together."""
        listed = not isinstance(doc_ids, DataFrame)
        gone = self.spark.createDataFrame([(d,) for d in doc_ids], "doc_id string") if listed else doc_ids.select("doc_id")
        t = self._store(collection).begin()
        build = t.meta.get("build")
        if build:
            old = t.read("chunks", keys=doc_ids) if listed else t.read("chunks").join(gone.distinct(), "doc_id", "left_semi")
            inverted.forget(t, _indexed(old), build["version"] + 1)
        for what in ("sources", "documents", "chunks"):
            if what in t.base["tables"]:
                t.delete(what, gone, "doc_id")
        t.commit()

    def usage(self, collection: str) -> DataFrame:
        return catalog.quota(self.documents(collection), self.quota)

    # Builds

    def preview(self, collection: str, config: chunking.Config, n: int = 5) -> tuple[DataFrame, DataFrame]:
        """The first chunks of each document, and the plan's totals with their cost."""
        chunks = chunking.chunk_documents(self.documents(collection).where("status <> 'failed'").select("doc_id", "text"), config)
        return chunking.preview(chunks, n), catalog.cost(chunking.plan_totals(chunks), self.dimension, "INT8")

    def evidence(self, collection: str, config: chunking.Config) -> DataFrame:
        chunks = chunking.chunk_documents(self.documents(collection).select("doc_id", "text"), config)
        return evidence.policy_checks(chunks, config.chunk_tokens, config.overlap_tokens, config.min_chunk_tokens)

    def build(self, collection: str, config: chunking.Config = chunking.Config(), full: bool = False) -> dict:
        """Chunks and embeds what isn't served yet, publishes, and marks the documents; gives mode, reason, documents and chunks.

        What others upload meanwhile stays pending, and what they remove stays removed. If another build replaced the chunks, this one begins again.
        """
        for _ in range(BUILD_ATTEMPTS):
            try:
                return self.begin_build(collection, config, full)()
            except Conflict as e:
                said = e
        raise said

    def begin_build(self, collection: str, config: chunking.Config = chunking.Config(), full: bool = False):
        """A build of what is uploaded now, to be called later; it gives what ``build`` gives, or raises ``Conflict`` where another build came before it."""
        self._known(collection)
        t = self._store(collection).begin()
        return lambda: self._build(collection, config, full, t)

    def _at_phase(self, collection: str, phase: str, **facts) -> None:
        """Notes what a background build is at."""
        job = self._jobs.get(collection)
        if job and job["running"]:
            with job["lock"]:
                job |= {"phase": phase} | facts

    def _build(self, collection: str, config: chunking.Config, full: bool, t: Transaction) -> dict:
        docs, served = t.read("documents"), t.meta.get("build")
        docs = self.spark.createDataFrame([], self._DOCUMENT) if docs is None else docs
        wanted = self._wanted(docs, config)
        viable, reason = (False, "a full build was asked for") if full else snapshots.viability(served, wanted)
        pending = docs.where("status <> 'failed'") if not viable else catalog.pending_documents(docs, True).where("status <> 'failed'")
        rows = inverted.documents(t.store, t.base)
        if viable and pending.isEmpty():
            return {"mode": "none", "reason": "nothing to embed", "documents": 0, "chunks": rows}
        chunks = chunking.chunk_documents(pending.where(~T.is_blank("text")).select("doc_id", "text"), config)
        if self.quota is not None:
            chunks = snapshots.kept(chunks, "chunks")
            used, planned = self.usage(collection).first()["used"], chunks.count() * self.dimension * 4
            if used + planned > self.quota:
                return {"mode": "refused", "reason": f"over the quota by {used + planned - self.quota} bytes", "documents": 0, "chunks": rows}
        made = self.spark.sparkContext.accumulator(0)
        fresh = embed.embedded(chunks, self.embedder, self.dimension, count=made)
        self._at_phase(collection, "chunks", documents=pending.count(), embedded=made)
        version = (served or {}).get("version", 0) + 1
        #: Chunks come from the documents' files, which are dealt by the same key: vectors are neither shuffled nor sorted.
        part = t.upsert("chunks", fresh, "doc_id", pending.select("doc_id"), dealt="ordered") if viable else t.replace("chunks", fresh, "doc_id", dealt="ordered")
        self._at_phase(collection, "index")
        old = t.read("chunks").join(pending.select("doc_id"), "doc_id", "left_semi") if viable else None
        inverted.update(t, _indexed(t.written("chunks")), version, None if old is None else _indexed(old), pending.select(F.col("doc_id").alias("owner")))
        self._at_phase(collection, "documents")
        counts = snapshots.kept(t.written("chunks").groupBy("doc_id").agg(F.count("*").alias("n")), "counts")
        marked = pending.join(counts, "doc_id", "left").withColumns({"chunks": F.coalesce("n", F.lit(0)).cast("long"), "status": F.lit("ready")})
        n = t.upsert("documents", marked.select(docs.columns), "doc_id", dealt="ordered")["rows"]
        left = rows - old.count() if viable else 0

        def removed(key, keys) -> None:
            """Documents that were removed while this build ran leave the index again."""
            inverted.forget(t, _indexed(t.written("chunks").join(keys, key, "left_semi")), version + 1)

        t.commit(drop_changed=removed, unless_changed=("build",), build=wanted | {"version": version}, built_at=self._now())
        out = {"mode": "incremental" if viable else "full", "reason": reason, "documents": n, "chunks": left + part["rows"]}
        self._say(collection, "info", f"{out['mode']} build: {n} documents embedded, {out['chunks']} chunks served")
        return out

    def build_plan(self, collection: str, config: chunking.Config = chunking.Config()) -> dict:
        """Whether a build may inherit chunks and why not, and how many documents and bytes it would embed."""
        docs = self.documents(collection)
        viable, reason = snapshots.viability(self._known(collection).get("build"), self._wanted(docs, config))
        pending = (catalog.pending_documents(docs, True) if viable else docs).where("status <> 'failed'")
        return {"mode": "incremental" if viable else "full", "reason": reason} | catalog.scope(pending).first().asDict()

    def stored_strategy(self, collection: str) -> dict | None:
        """What the served chunks were made with; None before the first build."""
        served = self._known(collection).get("build")
        return {k: served.get(k) for k in ("index", "chunking", "tokenizer", "parser")} if served else None

    def estimate_cost(self, collection: str, config: chunking.Config, quantizer: str = "INT8") -> DataFrame:
        """Cost of the whole collection under a policy: the plan's row for all documents."""
        chunks = chunking.chunk_documents(self.documents(collection).where("status <> 'failed'").select("doc_id", "text"), config)
        return catalog.cost(chunking.plan_totals(chunks).where("doc_id is null"), self.dimension, quantizer)

    def reparse_all(self, collection: str, config: chunking.Config = chunking.Config()) -> dict:
        """Converts every upload anew and builds in full."""
        self._known(collection)
        t = self._store(collection).begin()
        if (uploads := t.read("sources")) is not None:
            t.upsert("documents", self._parsed(uploads), "doc_id")
            t.commit(drop_changed=True)
        return self.build(collection, config, full=True)

    def _wanted(self, docs: DataFrame, config: chunking.Config) -> dict:
        parser = docs.where("status <> 'failed'").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("converter", F.lit("verbatim")))), ",").alias("p")).first()["p"]
        return {"index": {"metric": "cosine", "dimension": self.dimension}, "chunking": vars(config), "tokenizer": TOKENIZER, "parser": parser}

    # Builds in the background

    def start_build(self, collection: str, config: chunking.Config = chunking.Config(), full: bool = False) -> bool:
        """Builds in a thread of its own under a job group; False where one is running already."""
        self._known(collection)
        if self.build_status(collection).get("running"):
            return False
        job = {"group": uuid.uuid4().hex, "phase": None, "fraction": 0.0, "documents": 0, "running": True, "ok": None, "result": None, "error": None, "started_at": self._now(), "settled_at": None, "lock": threading.Lock()}
        self._jobs[collection] = job

        def work() -> None:
            self.spark.sparkContext.setJobGroup(job["group"], f"build of {collection}", interruptOnCancel=True)
            try:
                job["result"], job["ok"] = self.build(collection, config, full), True
            except Exception as e:  # noqa: BLE001  the caller asks for it by build_status
                said = re.findall(r"^(?:\w+\.)*\w*(?:Error|Exception): .+", str(e), re.M) or [str(e).strip().split("\n")[0] or type(e).__name__]
                shown = self.spark.range(1).select(T.build_error(F.lit(said[-1]))).first()[0] if not job.get("cancelled") else "cancelled"
                job["error"], job["ok"] = shown, False
                self._say(collection, "error", shown)
            with job["lock"]:
                job["fraction"] = 1.0 if job["ok"] else job["fraction"]
                job["settled_at"], job["running"] = self._now(), False

        job["thread"] = InheritableThread(target=work, daemon=True)
        job["thread"].start()
        return True

    def build_status(self, collection: str) -> dict:
        """running, ok, result, error and times of the last background build, and how far it is: documents to embed, chunks embedded, and a fraction that never falls;
        empty where there was none."""
        job = self._jobs.get(collection, {})
        if not job:
            return {}
        with job["lock"]:
            if job["running"]:
                job["fraction"] = max(job["fraction"], self._fraction(job))
            out = {k: job[k] for k in ("running", "ok", "result", "error", "started_at", "settled_at", "documents", "fraction")}
        return out | {"chunks": job["embedded"].value if job.get("embedded") else 0}

    def _fraction(self, job: dict) -> float:
        """The share of the phases that are over, and of the running phase's tasks that have ended."""
        if job["phase"] is None:
            return 0.0
        start, end = PHASES[job["phase"]]
        tracker = self.spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for s in tracker.getActiveStageIds()]
        mine = {s for j in tracker.getJobIdsForGroup(job["group"]) if (i := tracker.getJobInfo(j)) for s in i.stageIds}
        known = [(s.numCompletedTasks, s.numTasks) for s in stages if s and s.stageId in mine]
        done, total = sum(a for a, _ in known), sum(b for _, b in known)
        return start + (end - start) * (done / total if total else 0.0)

    def cancel_build(self, collection: str) -> bool:
        """Stops a running build's Spark jobs; what was served stays served."""
        job = self._jobs.get(collection)
        if not job or not job["running"]:
            return False
        job["cancelled"] = True
        self.spark.sparkContext.cancelJobGroup(job["group"])
        return True

    def wait_for_build(self, collection: str, seconds: float | None = None) -> dict:
        job = self._jobs.get(collection)
        if job:
            job["thread"].join(seconds)
        return self.build_status(collection)

    _LOG = "at string, level string, message string"

    def _say(self, collection: str, level: str, message: str) -> None:
        stored_files.append_log(self.spark.createDataFrame([(self._now(), level, message)], self._LOG).coalesce(1), self._at(collection, "log"))

    def log(self, collection: str, n: int = stored_files.LOG_TAIL) -> DataFrame:
        """The last things that builds said, the oldest first."""
        return stored_files.tail_log(self.spark, self._at(collection, "log"), self._LOG, "at", n)

    def inspect(self) -> DataFrame:
        """A read-only report: one row for each collection (``catalog.inspection``) with its bytes on disk."""
        docs, served = None, []
        for c in self.ids():
            one = self.documents(c).withColumn("collection", F.lit(c)).withColumn("built_at", F.col("at"))
            docs = one if docs is None else docs.unionByName(one)
            served.append((c, inverted.documents(self._store(c)), stored_files.measure(self.spark, self._at(c))[0]))
        if docs is None:
            docs = self.spark.createDataFrame([], f"{self._DOCUMENT}, collection string, built_at string")
        counts = self.spark.createDataFrame(served, "collection string, chunks long, disk_bytes long")
        return catalog.inspection(docs, self.collections(), counts).join(counts.select("collection", "disk_bytes"), "collection", "left")

    # Search

    def settings(self, collection: str, **asked) -> dict:
        return effective(asked, self._known(collection)["settings"])

    def set_settings(self, collection: str, **settings) -> dict:
        return self._save(collection, settings=self._known(collection)["settings"] | validated(settings))["settings"]

    def _pick(self, wanted: str | None) -> tuple[str | None, str | None]:
        listed = self.collections()
        if wanted is None:
            built = [r["collection"] for r in listed.where("built_at is not null").collect()]
            return (built[0], None) if len(built) == 1 else (None, "discovery_needed")
        r = catalog.resolve(listed, self.spark.createDataFrame([(wanted,)], "wanted string")).first()
        reasons = {"ok": None, "empty": "invalid_argument", "not_found": "collection_not_found", "ambiguous": "collection_ambiguous"}
        return r["collection"], reasons[r["status"]]

    def hits(self, collection: str, query: str, doc_ids: list[str] | None = None, **asked) -> tuple[DataFrame, DataFrame]:
        """Hits (with document name, place and line) and the one-row statistics of a search, both from one run over one version.

        Words are looked up in the stored index; texts are read of the hits alone. With ``doc_ids`` only these documents' chunks are candidates: the buckets of
        their ids are opened, no others (words keep their weight in the whole collection).
        """
        s = self.settings(collection, **asked)
        s["topk"] = max(1, min(50, s["topk"]))
        store = self._store(collection)
        record = store.record()
        chunks = store.read("chunks", record, keys=doc_ids)
        vector = [float(x) for x in self.embedder([query])[0]]
        words = query if s["mode"] == "hybrid" else ""
        q = self.spark.createDataFrame([(0, vector, words)], "query_id long, vector array<double>, text string")
        pool = max(s["candidates"], s["topk"])
        near = retrieval.dense(chunks.select(F.col("chunk_id").alias("id"), "vector"), q, pool)
        by_words = retrieval.or_none(lambda: inverted.search(store, q, pool, record, owners=doc_ids), q, chunks.select(F.col("chunk_id").alias("id")))
        found, stats = retrieval.searched(near, by_words, s["topk"], s["min_score"])
        found = snapshots.kept(found, "hits")
        owners = [r[0] for r in found.select(F.substring_index("id", "#", 1)).distinct().collect()]  # topk at most
        full = found.join(store.read("chunks", record, keys=owners).select(F.col("chunk_id").alias("id"), "doc_id", "ordinal", "text", "char_start", "char_end", "heading"), "id")
        docs = store.read("documents", record, keys=owners).select("doc_id", "name", F.col("text").alias("_source"))
        full = full.join(docs, "doc_id", "left")
        full = full.withColumn("name", F.coalesce("name", "doc_id")).withColumn("line", T.line_of("_source", F.col("char_start"))).drop("_source")
        return full.orderBy("rank"), stats

    def search(self, query: str, collection: str | None = None, topk: int | None = None, **asked) -> dict:
        """What a tool returns: ok, reason, summary, hits, below_floor, fts_only_hits, collections."""
        out = {"ok": False, "reason": None, "summary": "", "hits": [], "below_floor": 0, "fts_only_hits": 0, "collections": []}
        listed = [r.asDict() for r in self.collections().collect()]
        if not query.strip():
            return out | {"reason": "invalid_argument", "summary": "The query is empty."}
        found, reason = self._pick(collection)
        if reason is None and not self._known(found).get("build"):
            reason = "empty_result"
        if reason:
            return out | {"reason": reason, "summary": f"No search was made: {reason}.", "collections": listed}
        hits, stats = self.hits(found, query, topk=topk, **asked)
        rows = [r.asDict() | {"match_score": round(r["score"], 4)} for r in hits.collect()]
        s = stats.first()
        out |= {"ok": bool(rows), "reason": None if rows else "empty_result", "hits": rows, "below_floor": s["below_floor"] if s else 0, "fts_only_hits": s["fts_only_hits"] if s else 0}
        return out | {"summary": self.rendered(rows, out["below_floor"])}

    def embed_query(self, text: str) -> list[float]:
        return [float(x) for x in self.embedder([text])[0]]

    def retrieve(self, collection: str, query: str, topk: int = 8, min_score: float = 0.0, candidates: int = 100) -> dict:
        """A search for diagnosis: no floor unless asked for, whatever the collection's settings; with the seconds that its parts took and the version that was read."""
        import time

        self._known(collection)
        start = time.perf_counter()
        self.embed_query(query)
        embedded = time.perf_counter()
        hits, stats = self.hits(collection, query, topk=max(1, min(50, topk)), min_score=max(0.0, min(1.0, min_score)), candidates=max(20, min(1000, candidates)), mode="hybrid")
        rows, s = [r.asDict() for r in hits.collect()], stats.first()
        end = time.perf_counter()
        version = (self._known(collection).get("build") or {}).get("version")
        return {"hits": rows, "mode": s["mode"] if s else "dense", "below_floor": s["below_floor"] if s else 0, "version": version, "embed_s": embedded - start, "search_s": end - embedded}

    @staticmethod
    def rendered(hits: list[dict], below_floor: int) -> str:
        """Numbered hits with 300 characters of each."""
        shown = [f"{i}. [{h['band']} {h['match_score']:.4f}] {h['name']}:{h['line']} (chars {h['char_start']}-{h['char_end']}) {re.sub(r'\s+', ' ', h['text']).strip()[:300]}" for i, h in enumerate(hits, 1)]
        note = [f"{below_floor} more hits are below the score floor."] if below_floor else []
        return "\n".join([*shown, *note]) or "Nothing was found."

    def citation(self, address: str, context: int = lines.CONTEXT) -> DataFrame | None:
        """Lines around an address that ``functions.text.citation_address`` made; None where it isn't one."""
        r = self.spark.createDataFrame([(address,)], "a string").select(T.parsed_citation("a").alias("p")).first()["p"]
        if r is None or not ID.match(r["collection"]) or not self._meta(r["collection"]):
            return None
        docs = self.documents(r["collection"]).where(F.col("doc_id") == r["doc"]).select("doc_id", "text")
        cited = docs.select("doc_id", F.lit(r["line"]).alias("line"), F.lit(-1).alias("char_start"), F.lit(-1).alias("char_end"))
        return lines.citation(docs, cited, context).orderBy("line")
