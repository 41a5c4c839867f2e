"""The crawl: links of pages, what is still to be fetched, and the state of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extract as E
from ..functions import text as N
from ..functions import vocab
from ..functions.score import admissible, link_score
from ..plans.session import materialize
from ..plans.shape import computed

#: Anchors with their text; tags within it are dropped.
_ANCHOR = r'(?is)<a\b[^>]*?\bhref="([^"]*)"[^>]*>(.*?)</a>'


def page_links(pages: DataFrame) -> DataFrame:
    """(src_url, dst_url, anchor): every link of (url, html), resolved and normalised."""
    found = pages.select(F.col("url").alias("src_url"), F.explode(F.regexp_extract_all(N.text("html"), F.lit(_ANCHOR), F.lit(0))).alias("a"))
    href = F.regexp_extract("a", _ANCHOR, 1)
    anchor = N.clean_field(F.regexp_replace(F.regexp_extract("a", _ANCHOR, 2), "<[^>]*>", " "))
    parts = computed(found, F.col("src_url"), href.alias("href"), anchor.alias("anchor")).where("href != ''")
    target = computed(parts, F.col("src_url"), E.resolve("src_url", "href").alias("dst_url"), F.col("anchor"))
    return computed(target, F.col("src_url"), N.normalized_url("dst_url").alias("dst_url"), F.col("anchor"))


def scored_links(pages: DataFrame, same_domain: bool = True, **vocabulary) -> DataFrame:
    """(src_url, dst_url, score): links worth following, each pair and score once (SC3, A8)."""
    s = link_score("src_url", "dst_url", "anchor", same_domain, **vocabulary)
    return computed(page_links(pages), F.col("src_url"), F.col("dst_url"), s.alias("score")).where("score > 0").distinct()


def unseen(links: DataFrame, *seen: DataFrame) -> DataFrame:
    """Links whose target stands in none of the tables of addresses (url): anti-joins."""
    for table in seen:
        links = links.join(table.select(F.col("url").alias("dst_url")), "dst_url", "left_anti")
    return links


def enqueue(queue: DataFrame, links: DataFrame, run_key: str, depth: int) -> DataFrame:
    """The new rows of the queue: insert where the run hasn't the address yet (ST2); of several
    links to one address the best, then the first source."""
    fresh = unseen(links, queue.where(F.col("run_key") == run_key))
    w = Window.partitionBy("dst_url").orderBy(F.desc("score"), "src_url")
    best = fresh.withColumn("k", F.row_number().over(w)).where("k = 1")
    return best.select(F.lit(run_key).alias("run_key"), F.col("dst_url").alias("url"), F.lit("pending").alias("status"), F.lit(depth + 1).alias("depth"), F.col("src_url").alias("parent_url"))


def checkpoint(queue: DataFrame, run_key: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(processed, pending) pages of a run (ST4). ``limit`` keeps only the first pages by depth,
    as a bounded reader would; without it nothing is left out."""
    own = queue.where(F.col("run_key") == run_key)
    if limit is not None:
        own = own.orderBy("depth", "updated_at", "url").limit(limit)
    return own.where("status = 'processed'"), own.where(F.col("status").isin("pending", "failed", "processing"))


def crawl(pages: DataFrame, seeds: DataFrame, max_depth: int = 8, max_pages: int | None = None, same_domain: bool = True, **vocabulary) -> DataFrame:
    """(url, depth, fetched): breadth-first from seeds (url) over a table of fetched pages (ST5, ST7).

    One level a round, cut in the shared folder; a page counts as fetched if the
    table has it under its normal form. Stops at max_depth, when nothing new
    turns up, or at max_pages (levels are taken in order of address).
    """
    links = materialize(scored_links(pages, same_domain, **vocabulary).select(N.normalized_url("src_url").alias("src_url"), "dst_url").distinct())
    there = pages.select(N.normalized_url("url").alias("url")).distinct().withColumn("fetched", F.lit(True))
    level = seeds.select(N.normalized_url("url").alias("url")).where("url is not null").distinct().withColumn("depth", F.lit(0))
    seen = level = materialize(level)
    for depth in range(1, max(1, max_depth) + 1):
        found = level.join(links, level["url"] == links["src_url"]).select(F.col("dst_url").alias("url")).distinct()
        level = materialize(found.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)  # each level is written once
    out = seen.join(there, "url", "left").withColumn("fetched", F.coalesce("fetched", F.lit(False)))
    return out.orderBy("depth", "url").limit(max_pages) if max_pages else out


def cap_per_country(pages: DataFrame, most: int) -> DataFrame:
    """At most so many pages a country, in order of depth and address (ST7)."""
    w = Window.partitionBy(F.lower(N.text("country"))).orderBy("depth", "url")
    return pages.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most).drop("__k")


def discovered(pages: DataFrame, terms: list[str] = vocab.DISCOVERY_TERMS) -> DataFrame:
    """(src_url, dst_url, anchor, match_reasons): admissible links with a discovery term."""
    hits = E.terms_in(F.concat_ws(" ", "anchor", "dst_url"), terms)
    links = page_links(pages).where(admissible("src_url", "dst_url"))
    found = computed(links, *(F.col(c) for c in ("src_url", "dst_url", "anchor")), hits.alias("r"))
    return found.where(F.size("r") > 0).select("src_url", "dst_url", "anchor", F.array_join(F.slice("r", 1, 8), "; ").alias("match_reasons"))


# -- runs ---------------------------------------------------------------------------


def run_rollup(events: DataFrame) -> DataFrame:
    """The state of each run from its page events (run_key, seq, url, status, found, error) (ST3, A9).

    Counters come from processed pages; the last address from those and from
    failures with an error; the error is cut at 1,500 characters.
    """
    done, failed = F.col("status") == "processed", (F.col("status") != "processed") & N.present("error")
    at = F.struct("seq", "url")
    return events.groupBy("run_key").agg(
        F.count_if(done).alias("pages_crawled"),
        F.coalesce(F.sum(F.when(done, F.col("found"))), F.lit(0)).alias("providers_found"),
        F.max_by("url", F.when(done | failed, at)).alias("last_url"),
        F.max_by(F.substring("error", 1, 1500), F.when(failed, at)).alias("last_error"),
    )


def page_states(events: DataFrame) -> DataFrame:
    """(run_key, url, status, found): the last event of each page."""
    return events.groupBy("run_key", "url").agg(F.max_by("status", "seq").alias("status"), F.max_by("found", "seq").alias("found"))


def finished_status(reason: Column | str) -> Column:
    """completed if the run ran dry, paused, hence resumable, for any other reason (ST6)."""
    return F.when(N.text(reason) == "finished", "completed").otherwise("paused")


def latest_resumable(runs: DataFrame) -> DataFrame:
    """The run to resume: the last updated one that didn't complete (F8, ST8)."""
    return runs.where(F.col("status").isin("paused", "failed", "running")).orderBy(F.desc("updated_at"), F.desc("run_key")).limit(1)


def start_runs(runs: DataFrame, started: DataFrame) -> DataFrame:
    """runs with the started ones (run_key, mode, start_url, config) set to running (ST1): new
    rows come in, known ones keep mode and start address and lose error and completion."""
    old = runs.alias("r").join(started.alias("s"), "run_key", "full_outer")
    known, again = F.col("r.status").isNotNull(), F.col("s.mode").isNotNull()
    return old.select(
        "run_key",
        F.coalesce("r.mode", "s.mode").alias("mode"),
        F.coalesce("r.start_url", "s.start_url").alias("start_url"),
        F.when(again, "running").otherwise(F.col("r.status")).alias("status"),
        F.when(again, F.col("s.config")).otherwise(F.col("r.config")).alias("config"),
        F.when(again, F.current_timestamp()).otherwise(F.col("r.updated_at")).alias("updated_at"),
        F.when(again, None).otherwise(F.col("r.completed_at")).alias("completed_at"),
        F.when(again, None).otherwise(F.col("r.last_error")).alias("last_error"),
        F.when(known & again, "reopened").when(again, "started").alias("action"),
    )
