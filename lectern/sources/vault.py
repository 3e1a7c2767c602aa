"""Reading a vault: folders of Markdown with YAML frontmatter, as tables partitioned by kb.

The only module that touches Markdown, YAML and change reports. A vault has a
folder for each knowledge base (one with a `Wiki` folder and a `CLAUDE.md`).
Malformed frontmatter never fails a scan; it gives a parse error or a shape
note, which the audit reports.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lectern.functions import text as T
from lectern.functions.fixed import MEETING_SECTIONS
from lectern.operators import windows as W
from lectern.session import materialise, ship

SOURCE = "struct<id:string,resource:string,title:string,author:array<string>,last_modified:string,usage_count:bigint>"
STAMP = "struct<by:string,at:string>"
CONCEPT = (
    "struct<type:string,title:string,description:string,status:string,tags:array<string>,"
    f"generated:{STAMP},verified:array<{STAMP}>,stale_after:string,sources:array<{SOURCE}>,"
    "extras:map<string,string>,parse_error:string,shape:array<string>>"
)
#: File names that are no concepts, and no pages.
RESERVED, NOT_PAGES = ("index.md", "log.md"), ("_index.md", "_INGESTED.md")
KNOWN = ("type", "title", "description", "status", "tags", "generated", "verified", "stale_after", "sources")


def parse_frontmatter(block: str | None) -> dict:
    """One block as a concept struct."""
    out: dict = dict.fromkeys(("type", "title", "description", "status", "stale_after", "generated", "parse_error"))
    out |= {"tags": [], "verified": [], "sources": [], "extras": {}, "shape": []}
    if block is None:
        return out
    try:
        import yaml
    except ImportError:
        return out | {"parse_error": "no YAML library"}
    try:
        try:
            # libyaml, where PyYAML was built with it, is many times faster; what it rejects, PyYAML itself judges and words.
            data = yaml.load(block, getattr(yaml, "CSafeLoader", yaml.SafeLoader))
        except yaml.YAMLError:
            data = yaml.safe_load(block)
    except yaml.YAMLError as error:
        return out | {"parse_error": str(error).splitlines()[0]}
    if not isinstance(data, dict):
        return out | {"shape": ["frontmatter is not keys and values"]}
    say = lambda v: None if v is None else str(v)
    for key in ("type", "title", "description", "status", "stale_after"):
        out[key] = say(data.get(key))
    tags = data.get("tags") or []
    out["tags"] = [str(t) for t in tags] if isinstance(tags, list) else [str(tags)]
    if (made := data.get("generated")) is not None:
        if isinstance(made, dict):
            out["generated"] = {"by": say(made.get("by")), "at": say(made.get("at"))}
        else:
            out["shape"].append("generated is not a mapping")
    if (checked := data.get("verified")) is not None:
        if isinstance(checked, list):
            out["shape"].append("verified is a list")
        for one in checked if isinstance(checked, list) else [checked]:
            if isinstance(one, dict):
                out["verified"].append({"by": say(one.get("by")), "at": say(one.get("at"))})
            else:
                out["shape"].append("verified is not a mapping")
    sources = data.get("sources")
    if sources is not None and not isinstance(sources, list):
        out["shape"].append("sources is not a list")
        sources = []
    for entry in sources or []:
        if not isinstance(entry, dict):
            out["shape"].append("malformed source entry")
            continue
        if not isinstance(entry.get("id"), (str, type(None))):
            out["shape"].append("source id is not text")
        if not isinstance(entry.get("resource"), str):
            out["shape"].append("source resource is not a path")
        author = entry.get("author")
        count = entry.get("usage_count")
        out["sources"].append(
            {
                "id": say(entry.get("id")),
                "resource": say(entry.get("resource")),
                "title": say(entry.get("title")),
                "author": [str(a) for a in author] if isinstance(author, list) else [] if author is None else [str(author)],
                "last_modified": say(entry.get("last_modified")),
                "usage_count": count if isinstance(count, int) else None,
            }
        )
    out["extras"] = {str(k): str(v) for k, v in data.items() if k not in KNOWN}
    return out


def parse_blocks(blocks: pd.Series) -> pd.DataFrame:
    """Each distinct block of a batch is parsed once."""
    seen: dict = {}
    rows = []
    for block in blocks:
        if block not in seen:
            seen[block] = parse_frontmatter(block)
        rows.append(seen[block])
    names = ["type", "title", "description", "status", "tags", "generated", "verified", "stale_after", "sources", "extras", "parse_error", "shape"]
    return pd.DataFrame(rows, columns=names)


def frontmatter_struct(block: str | Column) -> Column:
    """The concept struct of a frontmatter block."""
    return F.pandas_udf(parse_blocks, CONCEPT)(block)


class Vault:
    """Tables of a vault. A table is made, and in a written vault written, when it is first asked for, so that a check
    pays for those that it reads; from then on it is an attribute like any other."""

    NAMES = ("files", "concepts", "citations", "pages", "lines", "footnotes", "links", "ledger", "changes", "options")

    def __init__(self, now: str, makers: dict[str, Callable[[], DataFrame]]) -> None:
        self.now, self._makers = now, makers

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.__dict__.get("_makers", {}):
            raise AttributeError(name)
        setattr(self, name, self._makers[name]())
        return self.__dict__[name]


def knowledge_bases(files: DataFrame) -> DataFrame:
    """Folders that hold both `Wiki/` and `CLAUDE.md`."""
    top = files.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("kb"), F.split_part("path", F.lit("/"), F.lit(2)).alias("inner"))
    return top.groupBy("kb").agg(F.bool_or(F.col("inner") == "Wiki").alias("wiki"), F.bool_or(F.col("inner") == "CLAUDE.md").alias("marker")).where("wiki AND marker").select("kb")


def live(kbs: DataFrame, table_text: DataFrame) -> DataFrame:
    """The kbs that a Markdown table (column text) doesn't mark as frozen."""
    rows = table_text.select(F.explode(F.split("text", "\n")).alias("row")).where(W.is_row(F.col("row")) & F.lower("row").contains("frozen"))
    frozen = rows.select(F.explode(W.row_cells(F.col("row"))).alias("kb")).select(F.regexp_replace("kb", r"[`*\[\]]", "").alias("kb"))
    return kbs.join(frozen.distinct(), "kb", "left_anti")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to the root), text, bytes and modification time of every text file."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    path = F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), r"^.*?\Q" + base.removeprefix("file:") + r"\E", "")
    return rows.select(path.alias("path"), F.decode("content", "UTF-8").alias("text"), F.length("content").cast("long").alias("bytes"), F.md5("content").alias("digest"), F.col("modificationTime").alias("modified"))


def tables(files: DataFrame, now: str, options: DataFrame | None = None, write: bool = False) -> Vault:
    """All tables of a vault from its files (path, text): S3, S5, S7, S9, S10, P1, P3, G1. With write they are written
    tables, each read from the one it comes from, so that Markdown and YAML are read once however many checks follow;
    YAML is read for the concepts and what comes from them, not for lines and links."""
    spark = files.sparkSession
    ship(spark)
    name = F.element_at(F.split("path", "/"), -1)

    def own() -> DataFrame:
        kbs = knowledge_bases(files)
        inside = files.withColumn("kb", F.split_part("path", F.lit("/"), F.lit(1))).join(F.broadcast(kbs), "kb").withColumn("path", F.regexp_replace("path", "^[^/]*/", ""))
        return inside.select("kb", "path", "text")

    def split() -> DataFrame:
        wiki = v.files.where(F.startswith(F.col("path"), F.lit("Wiki/")) & F.endswith(F.col("path"), F.lit(".md")) & ~name.isin(*RESERVED) & ~F.col("path").contains("/_trash/"))
        block = T.frontmatter(F.col("text"))
        return wiki.select("kb", "path", block.alias("fm"), T.body(F.col("text")).alias("body"), F.md5(F.coalesce(block, F.lit(""))).alias("key"))

    def concepts() -> DataFrame:
        # Equal blocks are parsed once: distinct blocks first, joined back by digest.
        parsed = split().groupBy("key").agg(F.first("fm").alias("fm")).select("key", frontmatter_struct("fm").alias("c"))
        return split().join(parsed, "key").select("kb", "path", "fm", "body", "c.*").withColumn("bare", T.strip_fences(F.col("body")))

    def citations() -> DataFrame:
        folder = F.regexp_replace("path", "/[^/]*$", "")
        rows = v.concepts.select("kb", "path", folder.alias("folder"), F.posexplode("sources").alias("pos", "s")).select("kb", F.col("path").alias("concept"), "folder", "pos", "s.*")
        return rows.withColumn("page", T.nfc_path(F.concat("folder", F.lit("/"), F.coalesce("resource", F.lit(""))))).drop("folder")

    def pages() -> DataFrame:
        layer = F.split_part("path", F.lit("/"), F.lit(1))
        in_layer = layer.isin("Raw", "OneNote", "folia") & F.endswith(F.col("path"), F.lit(".md")) & ~F.col("path").contains("/_assets/") & ~name.isin(*NOT_PAGES)
        head = lambda k: F.nullif(F.trim(F.regexp_extract(F.coalesce(T.frontmatter(F.col("text")), F.lit("")), rf"(?m)^{k}:[ \t]*(.*)$", 1)), F.lit(""))
        keys = ("title", "author", "source_url", "date_added", "date_published", "type", "created", "modified")
        return v.files.where(in_layer).select(
            "kb", "path", layer.alias("layer"), F.split_part("path", F.lit("/"), F.lit(2)).alias("chapter"), F.regexp_replace("path", "^[^/]*/|/[^/]*$", "").alias("scope"),
            *(F.regexp_replace(head(k), "^[\"']|[\"']$", "").alias(k) for k in keys), T.body(F.col("text")).alias("body"), F.lit(True).alias("is_text"),
        )

    def lines() -> DataFrame:
        docs = split().select(F.concat_ws("|", "kb", "path").alias("doc"), "body")
        # Only documents with a fence need their lines in order.
        fenced = F.coalesce(F.col("body").rlike(r"(?m)^\s*(```|~~~)"), F.lit(False))
        rows = W.unfenced(W.lines_of(docs.where(fenced), "body")).unionByName(W.lines_of(docs.where(~fenced), "body").withColumn("unclosed", F.lit(False)))
        return rows.select(F.split_part("doc", F.lit("|"), F.lit(1)).alias("kb"), F.split_part("doc", F.lit("|"), F.lit(2)).alias("concept"), "doc", "line", "body", "unclosed")

    def plain() -> DataFrame:
        return v.lines.withColumn("code_free", F.regexp_replace("body", r"`[^`]+`", " "))

    def footnotes() -> DataFrame:
        refs = plain().select("kb", "concept", "line", F.explode(F.regexp_extract_all("code_free", F.lit(r"\[\^([^\]]+)\](?!:)"), 1)).alias("label"), F.lit("ref").alias("kind"))
        notes = plain().where(F.col("body").rlike(r"^\[\^[^\]]+\]:")).select("kb", "concept", "line", F.regexp_extract("body", r"^\[\^([^\]]+)\]:", 1).alias("label"), F.lit("def").alias("kind"))
        return refs.unionByName(notes)

    def links() -> DataFrame:
        raw = plain().select("kb", F.col("concept").alias("src"), "line", F.explode(F.regexp_extract_all("code_free", F.lit(r"(?<!!)\[[^\]]*\]\(([^)\s]+)\)"), 1)).alias("dst_raw"))
        place = F.regexp_replace("dst_raw", "#.*$", "")
        return raw.select(
            "kb", "src", "line", "dst_raw", F.col("dst_raw").rlike("^https?://").alias("is_http"), F.col("dst_raw").contains("#").alias("has_fragment"), place.rlike(r"\.md$").alias("ends_md"),
            T.nfc_path(F.when(F.startswith(place, F.lit("/")), F.substring(place, F.lit(2), F.length(place))).otherwise(F.concat(F.regexp_replace("src", "/[^/]*$", ""), F.lit("/"), place))).alias("dst"),
        ).withColumn("is_self", F.col("src") == F.col("dst"))

    def ledger() -> DataFrame:
        return v.files.where(name == "_INGESTED.md").select("kb", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^\s*[-*]\s+`([^`]+)`"), 1)).alias("page"))

    def changes() -> DataFrame:
        report = "struct<generated:string,complete:boolean,changes:array<struct<path:string,status:string,contentChanged:boolean,movedFrom:string>>>"
        reports = v.files.where(name.rlike(r"^_CHANGES-.*\.json$")).select("kb", F.col("path").alias("report"), F.from_json("text", report).alias("r"))
        return reports.select("kb", "report", "r.generated", "r.complete", F.explode("r.changes").alias("c")).select("kb", "report", "generated", "complete", F.col("c.path").alias("page"), F.col("c.status").alias("status"), F.col("c.contentChanged").alias("content_changed"), F.col("c.movedFrom").alias("moved_from"))

    def given() -> DataFrame:
        return options if options is not None else spark.createDataFrame([], "kb string, key string, value string")

    kept = {"files": own, "concepts": concepts, "citations": citations, "pages": pages, "lines": lines, "footnotes": footnotes, "links": links}
    if write:
        kept = {k: lambda k=k, make=make: materialise(make(), f"vault_{k}") for k, make in kept.items()}
    v = Vault(now, kept | {"ledger": ledger, "changes": changes, "options": given})
    return v


def page_changes(changes: DataFrame) -> DataFrame:
    """The newest content change of each page."""
    return changes.where("content_changed").groupBy("kb", "page").agg(F.max("generated").alias("changed"))


def triage(changes: DataFrame) -> DataFrame:
    """What each changed page asks for."""
    act = F.when(F.col("status").isin("new", "modified") & F.col("content_changed"), "rebuild").when(F.col("status") == "archived", "remove").when(F.col("status") == "moved-or-deleted", "investigate").otherwise("ignore")
    return changes.withColumn("action", act)


def site_pages(pages: DataFrame, retired: DataFrame, lang: str, categories: list[str] | None = None) -> DataFrame:
    """The newest version of each mirrored page of a language; retired ones out. The version is the path's stamp."""
    stamped = pages.withColumn("stamp", F.regexp_extract("path", r"@([0-9]{8}(?:T[0-9]{6})?)", 1)).withColumn("page", F.regexp_replace("path", r"@[0-9]{8}(?:T[0-9]{6})?", ""))
    chosen = stamped.where((F.col("lang") == lang) & (F.col("category").isin(*categories) if categories else F.lit(True))).join(retired.select("page"), "page", "left_anti")
    return W.newest(chosen, ["page"], [F.desc("stamp"), F.desc("path")])


def inventory(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, digest, bytes), and (path, line, image) of images that name no file."""
    listed = files.select("path", "digest", "bytes")
    images = W.lines_of(files.select(F.col("path").alias("doc"), "text")).select(F.col("doc").alias("path"), "line", F.explode(F.regexp_extract_all("body", F.lit(r"!\[[^\]]*\]\(([^)\s]+)\)"), 1)).alias("image"))
    name = F.element_at(F.split("image", "/"), -1)
    known = files.select(F.element_at(F.split("path", "/"), -1).alias("name")).distinct()
    missing = images.where(~F.col("image").rlike("^https?://")).withColumn("name", name).join(known, "name", "left_anti").drop("name")
    return listed, missing


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests with their newest entry."""
    entry = "entries array<struct<build:bigint,date:string,title:string,detail:string>>"
    rows = spark.read.option("multiLine", True).schema(f"app string, build bigint, commit string, url string, sha256 string, minimumSystemVersion string, notes string, {entry}").json(path)
    latest = F.array_max(F.transform("entries", lambda e: F.struct(e["build"].alias("build"), e["title"].alias("title"))))
    return rows.select("app", "build", "sha256", latest["title"].alias("latest_title"))


def register_rows(text: DataFrame, width: int = 6) -> DataFrame:
    """Cells of the rows of a register's tables (kb, text), by width; header rows out."""
    lines = W.lines_of(text.select(F.col("kb").alias("doc"), "text")).where(W.is_row(F.col("body")) & ~W.is_separator(F.col("body")) & (W.row_width(F.col("body")) == width))
    return lines.select(F.col("doc").alias("kb"), "line", W.row_cells(F.col("body")).alias("cells"))


def meeting_sections(notes: DataFrame, kept: tuple[str, ...] = MEETING_SECTIONS) -> DataFrame:
    """The kept sections of notes (path, text); of two sections of one name the first."""
    parts = notes.select("path", F.posexplode(F.split("text", r"(?m)^## ")).alias("pos", "part")).where("pos > 0")
    titled = parts.select("path", "pos", F.trim(F.split_part("part", F.lit("\n"), F.lit(1))).alias("section"), F.regexp_replace("part", r"^[^\n]*\n?", "").alias("body")).where(F.col("section").isin(*kept))
    return titled.groupBy("path", "section").agg(F.min_by("body", "pos").alias("body"))


def action_items(text: DataFrame) -> DataFrame:
    """The items of five-cell tables (kb, text): id, raised, item, state, resolution."""
    rows = register_rows(text, 5)
    return rows.select("kb", "line", *(F.col("cells")[i].alias(n) for i, n in enumerate(("id", "raised", "item", "state", "resolution")))).where(~F.lower("id").isin("id", "#"))
