"""The stored corpus and its questions.

``build`` reads notes once and writes reports, lines, blocks, mentions, signals
and errors as Parquet into a new version folder, each table from the stored one
before it and partitioned by ``part``, the year; a pointer row is appended last,
so readers see whole versions only.  ``refresh`` parses the years in which a note
changed; a version's manifest names the folder that holds each year.  Questions with a year or with date bounds
read only their years and the undated notes.  A version holds the schema of each
table, so tables without rows read as such.  Counts are kept with each year
(``kept``), and caps are filled from the newest year on.  Every question returns DataFrames (or a dict of them)
over those tables.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import cache, cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import kept as K
from . import textindex
from ..functions import report as R
from ..functions.text import normalize, normalize_literal
from ..operators import analytics as A
from ..operators import reports, search
from ..sources.config import UserConfig
from ..sources.export import csv_text, json_text
from ..sources import sync
from ..sources.markdown import read_errors, read_markdown

TABLES = ("reports", "lines", "blocks", "mentions", "signals")
POINTER = "version string, indexed_at timestamp, source_dir string"
# How many rows the answers hold.
PROFILE_MENTIONS, PROFILE_SIGNALS = 1000, 40
RADAR_CHANGES, RADAR_FIRST, RADAR_SIGNALS, RADAR_LIMIT = 60, 60, 80, 24
STATUS_ERRORS = 100
STATUS = ("path", "indexed_at", "source_dir", "report_count", "latest_date", "mention_count", "target_count", "error_count", "errors")
#: Folders that a version may be spread over; beyond, a refresh builds anew.
MOST_FOLDERS = 8
MANIFEST = "part string, folder string"
#: Bytes of a row group in memory, which readers take as a whole.
ROW_GROUP = 32 << 20
SUMMARY_REPORTS, SUMMARY_INSTITUTIONS, SUMMARY_RADAR = 8, 18, 6
THEMES, TARGETS, DIVERGENCE, WATCH_CHANGES = 30, 30, 30, 5
MENTION_CSV = {
    "report_id": "reportId", "date": "date", "institution": "institution", "target_name": "targetName", "aliases": "aliases", "code": "code",
    "rating": "rating", "target_price": "targetPrice", "current_price": "currentPrice", "action": "action", "line_number": "lineNumber", "excerpt": "excerpt",
}
HIT_CSV = {"report_id": "reportId", "date": "date", "institution": "institution", "line_number": "lineNumber", "snippet": "snippet", "matched_text": "matchedText"}


def store(files: DataFrame, root: str, version: str, batch: str = "") -> None:
    """Write the tables of ``files`` below ``version``, each derived from the stored one before it.

    A ``batch`` has its own folder in each table and replaces an earlier one of the name.
    """
    spark, mode = files.sparkSession, "overwrite" if batch else "errorifexists"
    schemas: list[tuple[str, str]] = []

    def saved(name: str, df: DataFrame) -> DataFrame:
        df = df.withColumn("part", search.part_of(F.col("date")))
        schemas.append((name, df.schema.json()))
        # notes may be megabytes long, so a writer looks at its memory often
        df.write.partitionBy("part").mode(mode).option("parquet.block.size", ROW_GROUP).option("parquet.page.size.row.check.min", 4).parquet(f"{version}/{name}{batch}")
        return spark.read.schema(df.schema).parquet(f"{version}/{name}{batch}").drop("part")

    notes = saved("reports", reports.build_reports(files.where("markdown is not null"), root))
    lines = saved("lines", reports.build_lines(notes))
    blocks = saved("blocks", reports.build_blocks(lines))
    mentions = saved("mentions", reports.extract_mentions(lines))
    saved("signals", reports.extract_signals(mentions, lines))
    counts = K.counts(notes, blocks, mentions)
    K.dealt(counts).write.partitionBy("part", "kind").mode(mode).parquet(f"{version}/counts{batch}")
    sketches = K.sketches(spark.read.schema(counts.schema).parquet(f"{version}/counts{batch}"))
    sketches.write.partitionBy("part").mode(mode).parquet(f"{version}/sketches{batch}")
    schemas.extend([("counts", counts.schema.json()), ("sketches", sketches.schema.json())])
    errors = read_errors(files)
    errors.write.mode(mode).parquet(f"{version}/errors{batch}")
    schemas.append(("errors", errors.schema.json()))
    spark.createDataFrame(schemas, "name string, schema string").coalesce(1).write.mode("overwrite").json(f"{version}/schemas")


def publish(spark: SparkSession, version: str, out: str, root: str) -> Index:
    spark.createDataFrame([(version, datetime.now(UTC), root)], POINTER).coalesce(1).write.mode("append").json(f"{out.rstrip('/')}/current")
    return Index(spark, version)


def _new_version(out: str) -> str:
    return f"{out.rstrip('/')}/v-{datetime.now(UTC):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"


def build(spark: SparkSession, files: DataFrame, root: str, out: str, kept: dict[str, str] | None = None) -> Index:
    """Ingest ``files`` (file_path, markdown, updated_at) into ``out``; those without content become errors and the rest goes on.

    ``kept`` names the folders of years that stay as they are in other versions.
    """
    version = _new_version(out)
    store(files, root, version)
    made = {r["part"]: version for r in Index(spark, version).reports.select("part").distinct().collect()}  # years
    spark.createDataFrame(sorted((made | (kept or {})).items()), MANIFEST).coalesce(1).write.json(f"{version}/manifest")
    return publish(spark, version, out, root)


def build_from_tree(spark: SparkSession, root: str, out: str) -> Index:
    return build(spark, read_markdown(spark, root), root, out)


def _pointer(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(POINTER).json(f"{out.rstrip('/')}/current").orderBy(F.desc("indexed_at"), F.desc("version"))


def open_index(spark: SparkSession, out: str, root: str | None = None) -> Index:
    """The newest version; where there is none and ``root`` names notes, they are ingested first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{out.rstrip('/')}/current")
    if root is not None and not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return build_from_tree(spark, root, out)
    return Index(spark, _pointer(spark, out).first()["version"])


def refresh(spark: SparkSession, root: str, out: str, runner: sync.Runner = sync.run_git) -> dict:
    """Pull the notes, ingest what changed and compare: the pull's outcome, the index, its status and what changed.

    If the pull fails nothing is ingested and the index stays as it is.
    """
    before = open_index(spark, out, root)
    pulled = sync.refresh(root, runner)
    if not pulled.success:
        return {"sync": pulled, "index": before, "status": before.status(), "changes": None}
    after = update(before, root, out)
    changes = after.diff(before)
    return {"sync": pulled, "index": after, "status": after.status() | {"last_changes": changes.count()}, "changes": changes}


def update(before: Index, root: str, out: str) -> Index:
    """A version of the tree as it is now, equal to one built anew: only years with an added, changed or removed note are parsed."""
    spark, folders = before.spark, before.folders
    if not folders or not before.keeps_counts or len(set(folders.values())) >= MOST_FOLDERS:
        return build_from_tree(spark, root, out)
    part = search.part_of(reports.report_date(F.col("file_path"), reports.report_id(F.col("file_path"), root)))
    seen = lambda notes, name: notes.where("markdown is not null").select("file_path", F.struct(F.xxhash64("markdown"), F.length("markdown"), "updated_at").alias(name))
    files = read_markdown(spark, root)
    met = seen(files, "now").join(seen(before.reports, "was"), "file_path", "full").where("not (now <=> was)")
    changed = [r["part"] for r in met.select(part.alias("part")).distinct().collect()]  # years
    troubled = [r["part"] for r in before.errors.select(part.alias("part")).union(files.where("markdown is null").select(part)).distinct().collect()]
    again = sorted({*changed, *troubled})
    if not again:
        return publish(spark, before.path, out, root)
    kept = {p: folder for p, folder in folders.items() if p not in again}
    return build(spark, read_markdown(spark, root, part.isin(again)), root, out, kept)


class Answer(Mapping):
    """An answer of named parts, each of which is made when it is first asked for."""

    def __init__(self, **parts: Callable[[], object]):
        self._parts, self._made = parts, {}

    def __getitem__(self, name: str) -> object:
        if name not in self._made:
            self._made[name] = self._parts[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._parts)

    def __len__(self) -> int:
        return len(self._parts)


def _held(df: DataFrame) -> DataFrame:
    """A frame that ends in a limit, read once and kept as a local relation."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def profile_summary(mentions: DataFrame) -> DataFrame:
    """First and latest mention, the latest one's rating and price, and the tone of the excerpts, in one row."""
    latest = F.struct("date", *A.SEQ)
    good, bad = R.sentiment_counts(F.col("excerpt"))
    return mentions.agg(
        F.min("date").alias("first_mention"), F.max("date").alias("latest_mention"), F.max_by("rating", latest).alias("latest_rating"),
        F.max_by("target_price", latest).alias("latest_target_price"), R.sentiment_hint(good, bad).alias("sentiment_hint"),
    )


@dataclass
class Index:
    spark: SparkSession
    path: str

    @cached_property
    def _schemas(self) -> dict[str, StructType]:
        rows = self.spark.read.schema("name string, schema string").json(f"{self.path}/schemas").collect()
        return {r["name"]: StructType.fromJson(json.loads(r["schema"])) for r in rows}

    @cached_property
    def folders(self) -> dict[str, str]:
        """The version folder that holds each part; none where the version has no manifest and holds all itself."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return {}
        return {r["part"]: r["folder"] for r in self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest").collect()}

    def _table(self, name: str) -> DataFrame:
        """A stored table, by its own schema: it may have no rows."""
        read = lambda folder: self.spark.read.schema(self._schemas[name]).parquet(f"{folder}/{name}").drop("batch")
        out = read(self.path)
        if name == "errors":
            return out
        others: dict[str, list[str]] = {}
        for part, folder in self.folders.items():
            if folder != self.path:
                others.setdefault(folder, []).append(part)
        for folder, parts in sorted(others.items()):
            out = out.unionByName(read(folder).where(F.col("part").isin(parts)))
        return out

    reports = cached_property(lambda self: self._table("reports"))
    lines = cached_property(lambda self: self._table("lines"))
    blocks = cached_property(lambda self: self._table("blocks"))
    mentions = cached_property(lambda self: self._table("mentions"))
    signals = cached_property(lambda self: self._table("signals"))
    errors = cached_property(lambda self: self._table("errors"))
    keeps_counts = property(lambda self: "counts" in self._schemas)

    @cached_property
    def counts(self) -> DataFrame:
        """The counts kept with the version; of a version without them, counted now."""
        return self._table("counts") if self.keeps_counts else K.counts(self.reports, self.blocks, self.mentions)

    @cached_property
    def sketches(self) -> DataFrame:
        return self._table("sketches") if self.keeps_counts else K.sketches(self.counts)

    def target_count(self, years: list[str] | None = None, exact: bool = True) -> int:
        """How many targets are mentioned, in some years or in all; if not ``exact``, by one sketch for each year."""
        return K.distinct_targets(self.counts, years) if exact else K.about_distinct_targets(self.sketches, years)

    def newest(self, table: DataFrame, ask: Callable[[DataFrame], DataFrame], limit: int, start: str | None = None, end: str | None = None) -> DataFrame:
        """``ask`` of the rows of a period, which yields at most ``limit`` rows with a ``date``, newest first.

        Years are read from the newest on, four times as many at each step.  All rows
        of a year that was not read are older than the oldest year read, so once
        ``limit`` rows are not, none of them can enter.  Undated notes, whose ids may
        come anywhere, are always read.
        """
        rows, n = table.where(search.in_period(start, end)), 1
        years = sorted((p for p in self.folders if p != search.UNDATED and p >= (start or "")[:4] and (not end or p <= end[:4])), reverse=True)
        while 4 * n <= len(years):  # all steps together read a third of the years at most
            some = ask(rows.where(F.col("part").isin(*years[:n], search.UNDATED)))
            found = some.collect()  # at most ``limit``
            if sum(r["date"] >= years[n - 1] for r in found) >= limit:
                return self.spark.createDataFrame(found, some.schema)
            n *= 4
        return ask(rows)

    # reports

    def summaries(self, notes: DataFrame | None = None, few: bool = False) -> DataFrame:
        """Report rows with their institutions in order and their number of mentions (by id, as ids may collide)."""
        notes = self.reports if notes is None else notes
        of = lambda rows, key: rows.join(F.broadcast(notes.select(key)), key, "left_semi") if few else rows
        held = of(self.blocks, "file_path").groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("start_line", "institution"))).alias("b"))
        told = of(self.mentions, "report_id").groupBy("report_id").agg(F.count("*").alias("target_count"))
        out = notes.join(held, "file_path", "left").join(told, "report_id", "left")
        names = F.coalesce(F.transform("b", lambda b: b["institution"]), F.array().cast("array<string>"))
        return out.select("report_id", "date", "year", "file_path", "title", names.alias("institutions"), F.coalesce("target_count", F.lit(0)).cast("bigint").alias("target_count"), "line_count", "updated_at")

    def list_reports(self, year: str | None = None, institution: str | None = None) -> DataFrame:
        notes = self.reports if not year else self.reports.where(F.col("part").isin(year[:4], search.UNDATED)).where(F.col("year") == year)
        return self.summaries(self._with_institution(notes, institution)).orderBy(F.desc("date"), F.desc("file_path"))

    def _with_institution(self, notes: DataFrame, institution: str | None) -> DataFrame:
        if not institution:
            return notes
        return notes.join(self.blocks.where(F.col("institution") == institution).select("file_path"), "file_path", "left_semi")

    def report(self, report_id: str) -> dict[str, DataFrame]:
        """The first report of the id, its blocks, and all mentions of the id."""
        one = self.reports.where(F.col("report_id") == report_id).orderBy("date", "file_path").limit(1)
        return {
            "report": self.summaries(one).join(one.select("file_path", "markdown"), "file_path"),
            "blocks": self.blocks.join(one.select("file_path"), "file_path", "left_semi").orderBy("start_line"),
            "mentions": self.mentions.where(F.col("report_id") == report_id).orderBy(*A.SEQ),
        }

    def diff(self, before: Index) -> DataFrame:
        """Reports added, modified and removed since ``before``, newest first."""
        ours = self.reports.select("report_id", F.struct("date", "file_path", "markdown").alias("v"), F.col("updated_at").alias("u"))
        last = before.reports.groupBy("report_id").agg(F.max_by(F.struct("markdown", "updated_at"), F.struct("date", "file_path")).alias("p"))
        met = ours.join(last, "report_id", "left")
        kind = F.when(F.col("p").isNull(), "added").when(F.col("p.markdown") != F.col("v.markdown"), "modified")
        changed = met.withColumn("change_type", kind).where("change_type is not null")
        changed = self.summaries().join(changed.select(F.col("v.file_path").alias("file_path"), "change_type", F.col("p.updated_at").alias("previous_updated_at")), "file_path").withColumn("next_updated_at", F.col("updated_at"))
        gone = before.reports.join(self.reports.select("report_id"), "report_id", "left_anti").select("file_path")
        gone = before.summaries().join(gone, "file_path", "left_semi").withColumns({"change_type": F.lit("removed"), "previous_updated_at": F.lit(None).cast("timestamp"), "next_updated_at": F.col("updated_at")})
        return changed.unionByName(gone).orderBy("change_type", F.desc("date"), A.by_name("report_id"), "report_id")

    # searches

    def search(self, q: str | None = None, start: str | None = None, end: str | None = None, institution: str | None = None, mode: str | None = None) -> DataFrame:
        wanted = R.parse_rating_query(q, mode)
        if wanted:
            def rated(mentions: DataFrame) -> DataFrame:
                if institution:  # of an id's reports all have its date
                    notes = self._with_institution(self.reports.where(search.in_period(start, end)), institution)
                    mentions = mentions.join(notes.select("report_id"), "report_id", "left_semi")
                return search.search_ratings(mentions, wanted)

            return self.newest(self.mentions, rated, search.LIMIT, start, end)
        text = normalize_literal(q or "")
        indexed = len(text) >= textindex.GRAM and self._has_text_index
        near = textindex.candidates(self.spark, self._text_index, text) if indexed else None

        def said(lines: DataFrame) -> DataFrame:
            some = lines.join(near, ["part", "file_path", "line_no"], "left_semi") if indexed else lines
            return search.search_lines(self._with_institution(some, institution), q, mode, among=lines)

        return self.newest(self.lines, said, search.LIMIT, start, end)

    @property
    def _text_index(self) -> str:
        return f"{self.path}/text-index"

    @cached_property
    def _has_text_index(self) -> bool:
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._text_index}/counts/_SUCCESS")
        return done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done)

    def with_text_index(self) -> Index:
        """The same version with an index of its lines for exact searches, made if there is none."""
        if not self._has_text_index:
            textindex.write(self.lines, self._text_index)
        return Index(self.spark, self.path)

    # targets

    def profile(self, query: str, config: UserConfig | None = None) -> dict[str, DataFrame]:
        names = config.expand(query) if config else [query]
        named = search.mention_matches(F.col("norm_fields"), [normalize_literal(n) for n in names])
        latest = lambda rows: rows.where(named).orderBy(F.desc("date"), *[F.desc(c) for c in A.SEQ]).limit(PROFILE_MENTIONS)
        # every part of the answer is made of these rows, which are few whatever the corpus
        newest = _held(self.newest(self.mentions, latest, PROFILE_MENTIONS))
        owner = newest.select(F.col("file_path").alias("f"), F.col("line_number").alias("l"), F.col("match_no").alias("m"))
        here = (F.col("file_path") == F.col("f")) & (F.col("mention_line") == F.col("l")) & (F.col("match_no") == F.col("m"))
        signals = self.signals.join(owner, here, "left_semi").orderBy(F.desc("date"), F.desc("file_path"), F.desc("mention_line"), F.desc("match_no"), F.desc("line_number")).limit(PROFILE_SIGNALS)
        asked = F.lit(normalize_literal(query))
        called = newest.groupBy("target_name").agg(F.min(F.struct("date", *A.SEQ)).alias("first")).withColumn("norm_name", normalize("target_name"))
        fits = F.contains("norm_name", asked) | F.contains(asked, F.col("norm_name"))
        called = called.orderBy(F.desc(fits), F.when(fits, F.length("target_name")).otherwise(0), "first").limit(1).select(F.col("target_name").alias("canonical_name"))
        if newest.isEmpty():  # an unknown target is called what was asked for
            called = self.spark.createDataFrame([(query,)], "canonical_name string")
        aliases = newest.select("date", *A.SEQ, F.posexplode("aliases").alias("i", "alias")).groupBy("alias").agg(F.min(F.struct("date", *A.SEQ, "i")).alias("first"))
        order = ("date", *A.SEQ)
        return {
            "mentions": newest,
            "canonical_name": called,
            "summary": profile_summary(newest),
            "aliases": self.spark.createDataFrame([(n,) for n in names], "alias string") if newest.isEmpty() else aliases.orderBy("first").select("alias"),
            "institutions": newest.select("institution").distinct().orderBy("institution"),
            "rating_changes": A.detect_changes(newest).orderBy(*A.change_order()),
            "matrix": A.institution_matrix(newest, order=order).orderBy(*A.matrix_order()),
            "signals": signals,
            "rating_distribution": A.count_by(newest, F.col("rating")),
            "target_prices": newest.where("target_price is not null").orderBy(F.desc("date"), F.desc("line_number"), "file_path", "match_no").select("date", "institution", "target_price"),
        }

    def radar(self, start: str | None = None, end: str | None = None, limit: int = RADAR_LIMIT) -> Answer:
        """Dates are filtered before changes are looked for; the first cut comes before the split by type."""
        changes = cache(lambda: _held(A.detect_changes(self.mentions.where(search.in_period(start, end))).orderBy(*A.change_order()).limit(RADAR_CHANGES)))
        opened = F.contains(F.coalesce("action", F.lit("")), F.lit("首次")) | F.contains("excerpt", F.lit("首次覆盖")) | F.contains("excerpt", F.lit("首予"))
        later, most = [F.desc("date"), F.desc("line_number"), F.asc("file_path"), F.asc("match_no")], min(RADAR_FIRST, limit)
        first = lambda: self.newest(self.mentions, lambda rows: rows.where(opened).orderBy(*later).limit(most), most, start, end)
        kept = lambda df, by: df.orderBy(*by).limit(limit)
        by_line = [F.desc("date"), F.desc("line_number"), F.asc("file_path"), F.asc("mention_line"), F.asc("match_no")]
        told = cache(lambda: _held(self.newest(self.signals, lambda rows: rows.orderBy(*by_line).limit(RADAR_SIGNALS), RADAR_SIGNALS, start, end)))
        return Answer(
            first_coverages=first,
            rating_changes=lambda: kept(changes(), A.change_order()),
            target_price_changes=lambda: kept(changes().where(F.contains("change_type", F.lit("目标价"))), A.change_order()),
            catalysts=lambda: kept(told().where(F.col("type") == "catalyst"), by_line),
            risks=lambda: kept(told().where(F.col("type") == "risk"), by_line),
            themes=lambda: self.themes(min(THEMES, limit)),
        )

    def themes(self, limit: int = THEMES) -> DataFrame:
        return K.top(self.counts, K.TAG, limit)

    def institutions(self, target: str | None = None, institution: str | None = None) -> dict[str, DataFrame]:
        mentions = self.mentions
        if target:
            mentions = mentions.where(search.mention_matches(F.col("norm_fields"), [normalize_literal(target)]))
        if institution:
            mentions = mentions.where(F.col("institution") == institution)
        matrix, some = A.institution_matrix(mentions), target or institution
        return {
            "matrix": matrix.orderBy(*A.matrix_order()),
            "coverage": A.count_by(mentions, F.col("institution")) if some else K.top(self.counts, K.COVERAGE),
            "target_coverage": A.count_by(mentions, F.col("target_name"), TARGETS) if some else K.top(self.counts, K.TARGET, TARGETS),
            "divergence": A.diverging_names(matrix, limit=DIVERGENCE),
        }

    def watchlist(self, config: UserConfig) -> dict[str, DataFrame]:
        watch = config.watch_frame(self.spark)
        met = A.match_watchlist(self.mentions, F.col("norm_fields"), watch, A.SEQ)
        own = met.withColumn("_own", F.concat_ws("|", "watch_id", "target_key"))
        changes = A.detect_changes(own, key="_own", keep=("watch_id", "target_key", "target_name", "report_id", "line_number"))
        by_item = A.Window.partitionBy("watch_id").orderBy(*A.change_order())
        changes = changes.withColumn("n", F.row_number().over(by_item)).where(F.col("n") <= WATCH_CHANGES).drop("_own", "n")
        shown = ("report_id", "institution", "target_name", "rating", "target_price", "line_number")
        return {"watchlist": A.watch_summary(met, watch, "date", A.SEQ, shown), "latest_changes": changes}

    # whole answers

    def status(self) -> dict:
        """Where and when the index was made, how much it holds, and the files that could not be read."""
        out, version = self.path.rsplit("/", 1)
        held = K.totals(self.counts)
        indexed = _pointer(self.spark, out).where(F.endswith("version", F.lit(f"/{version}"))).first()
        return {
            "path": self.path, "indexed_at": indexed["indexed_at"] if indexed else None,
            "source_dir": indexed["source_dir"] if indexed else None, "report_count": held["reports"], "latest_date": held["latest"],
            "mention_count": held["mentions"], "target_count": held["targets"],
            "error_count": self.errors.count(), "errors": self.errors.orderBy("file_path").limit(STATUS_ERRORS),
        }

    def summary(self) -> Answer:
        status = cache(self.status)
        return Answer(
            **{name: lambda name=name: status()[name] for name in STATUS},
            years=lambda: K.top(self.counts, K.YEAR),
            institutions=lambda: K.top(self.counts, K.INSTITUTION, SUMMARY_INSTITUTIONS),
            latest_reports=self.latest_reports,
            radar=lambda: self.radar(limit=SUMMARY_RADAR),
        )

    def latest_reports(self) -> DataFrame:
        """Institutions and mentions are gathered for these reports only."""
        newest = [F.desc("date"), F.desc("file_path")]
        notes = self.reports.select("report_id", "date", "year", "file_path", "title", "line_count", "updated_at").orderBy(*newest).limit(SUMMARY_REPORTS)
        return self.summaries(notes, few=True).orderBy(*newest)

    def export(self, kind: str, q: str | None = None, config: UserConfig | None = None) -> str:
        """CSV of a target's mentions or of a search's hits; anything else is the summary as JSON."""
        if kind == "target" and q:
            return csv_text(self.profile(q, config)["mentions"], MENTION_CSV)
        if kind == "search" and q:
            return csv_text(self.search(q), HIT_CSV)
        return json_text(self.summary())
