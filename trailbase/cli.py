"""Command line: walk a table of pages, look into a run, judge its pages again.

    python -m trailbase.cli run "rust compilers" --pages DIR --store DIR [--model m:f] [--embedder m:f] [--robots DIR] [--blacklist FILE]
    python -m trailbase.cli report --store DIR --run RUN
    python -m trailbase.cli inspect --store DIR --run RUN [--export csv|json --to DIR]
    python -m trailbase.cli replay --store DIR --run RUN --model package.module:function
"""

from __future__ import annotations

import argparse
import datetime
import importlib
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runlog
from .functions import urls
from .operators import analysis_queue, analytics, analyze, feedback, html, prefilter, rank, store
from .plans import rounds
from .settings import Settings
from .sources import seeds


def _candidates(pages: DataFrame) -> DataFrame:
    links = html.page_links_table(pages).withColumn("u", urls.url_struct(F.col("href"), F.col("base_url")))
    source = urls.fingerprint(urls.canonical_url(F.col("base_url")))
    none = F.lit(None).cast("double")
    return links.select("u.*", "href", "anchor", "snippet", "position", "link_count", source.alias("source_url_key"), F.col("title").alias("source_title"), none.alias("domain_prior"), F.concat_ws("-", source, F.col("position").cast("string")).alias("candidate_id"))


def run(spark: SparkSession, prompt: str, pages: DataFrame, root: str, settings: Settings = Settings(), model=None, seed_urls: str = "", embedder=None, robots: DataFrame | None = None, blacklist: DataFrame | None = None) -> tuple[str, str]:
    """Walk the pages for a goal and store what happened; returns the run's name and why it ended.

    model: judges pages, and asks again later where it fails; embedder: ranks
    links by likeness to the goal; robots: domain and raw; blacklist: reg_domain.
    """
    now = datetime.datetime.now(datetime.UTC)
    goal, run_id = analyze.enhance(prompt, model, now), now.strftime("%Y%m%d_%H%M%S")
    runs = store.RunStore(spark, root)
    records = html.page_records(pages, F.lit(now)).withColumn("reg_domain", urls.reg_domain(urls.host_of(F.col("canonical"))))
    start = seeds.manual(spark, seed_urls) if seed_urls else seeds.from_column(pages, F.col("url"))
    limits = replace(settings.limits(), since=goal.since)
    items, _ = rounds.ingest_seeds(start, limits=limits)
    barred = tuple(r.reg_domain for r in blacklist.select("reg_domain").distinct().collect()) if blacklist is not None else prefilter.DEFAULT_BLACKLIST  # a file that people write
    vector = (lambda: rank.goal_vector(spark, goal.statement, goal.prompt, embedder)) if embedder is not None else None
    queue = analysis_queue.AnalysisQueue(spark, goal, model) if model is not None else None

    def score(found: DataFrame) -> DataFrame:
        """The funnel's survivors with their priority."""
        seen = found if embedder is None else rank.with_vectors(found, embedder)
        decisions = rank.plan(seen, list(goal.keywords), vector, threshold=settings.rule_threshold, keep=settings.keep, weight=settings.blend_weight)
        return found.join(decisions.filter("not dropped").select("candidate_id", "priority"), "candidate_id")

    def judge(found: DataFrame) -> DataFrame:
        """What the model makes of a round's pages, and of earlier ones that are due again; what it costs is taken as four characters a token."""
        rows = queue.step(found, walk.pages)
        names = walk.pages.select("url_key", F.col("canonical").alias("url"), F.col("reg_domain").alias("domain"), "title", F.ceil(F.length(F.coalesce("plain_text", F.lit(""))) / 4).cast("long").alias("tokens"))
        judged = rows.filter("outcome = 'ok'").join(names, "url_key")
        return judged.select("url_key", "url", "domain", "title", "classification", "relevance_score", "hub_score", "topics", "endorsed_links", "tokens")

    walk = rounds.Walk(spark, records, _candidates(pages), score, limits, judge=judge if model is not None else None, robots=robots, priors=runs.priors(), rules=prefilter.default_rules(barred))
    visited, audit, why = walk.run(items)
    counted = walk.rounds()
    runs.append("rounds", run_id, counted.withColumn("seq", F.col("round")))
    fetched = walk.pages.drop("reg_domain").join(visited.select("url_key", "round"), "url_key").withColumn("fetched_seq", F.col("round")).orderBy("round")
    runs.append("crawl_goals", run_id, spark.createDataFrame([(goal.goal_id, goal.prompt, goal.statement, list(goal.keywords), 1)], "goal_id string, prompt string, goal_statement string, keywords array<string>, seq long"))
    runs.append("crawl_tasks", run_id, spark.createDataFrame([(run_id, goal.goal_id, "COMPLETED", why, 1)], "task_id string, goal_id string, state string, stopping_reason string, seq long"))
    runs.append("pages", run_id, fetched)
    runs.append("events", run_id, store.walk_events(run_id, visited, audit, why))
    runs.append("links", run_id, audit.withColumn("candidate_id", F.concat_ws("-", "source_url_key", "url_key")).orderBy("round"))
    if model is not None:
        runs.append("analyses", run_id, queue.results())
        runs.add_priors(run_id, feedback.prior_deltas(walk.judgements()))
    return run_id, why


def _model(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("run", "inspect", "replay", "report"):
        sub = commands.add_parser(name)
        sub.add_argument("--store", required=True)
        if name == "run":
            sub.add_argument("prompt")
            sub.add_argument("--pages", required=True)
            sub.add_argument("--seeds", default="")
            sub.add_argument("--settings", help="a file of TRAILBASE_NAME=value lines")
            for flag in ("--embedder", "--robots", "--blacklist"):
                sub.add_argument(flag)
            for flag in ("--max-pages", "--depth-limit", "--domain-budget", "--round-size"):
                sub.add_argument(flag, type=int)
        else:
            sub.add_argument("--run", required=True)
        if name == "inspect":
            sub.add_argument("--export", choices=("csv", "json"))
            sub.add_argument("--to")
        if name in ("run", "replay"):
            sub.add_argument("--model")
        sub.add_argument("--log-level", default="WARNING")
        sub.add_argument("--log-format", choices=("text", "json"), default="text")
        sub.add_argument("--log-file")
    args = parser.parse_args(argv)
    runlog.setup(args.log_level, args.log_format, args.log_file)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    runs = store.RunStore(spark, args.store)
    model = _model(args.model) if getattr(args, "model", None) else None
    if args.command == "run":
        settings = Settings.load(args.settings, max_pages=args.max_pages, depth_limit=args.depth_limit, domain_budget=args.domain_budget, round_size=args.round_size)
        embedder = _model(args.embedder) if args.embedder else None
        robots = spark.read.parquet(args.robots) if args.robots else None
        blacklist = seeds.blacklist(spark, args.blacklist) if args.blacklist else None
        run_id, why = run(spark, args.prompt, spark.read.parquet(args.pages), args.store, settings, model, args.seeds, embedder, robots, blacklist)
        print(f"{run_id}: {runs.read('pages', run_id).count()} pages, ended by {why}")
    elif args.command == "report":
        task = runs.read("crawl_tasks", args.run).first()
        analyses = runs.read("analyses", args.run) if runs.has("analyses") else spark.createDataFrame([], "outcome string, classification string")
        print(analytics.report_lines(analytics.report(runs.read("rounds", args.run), runs.read("links", args.run), analyses).first().asDict(), task["state"], task["stopping_reason"]))
    elif args.command == "inspect":
        pages, analyses = runs.read("pages", args.run), runs.read("analyses", args.run)
        if args.export:
            store.write_export(store.export(analyses, pages), args.to, args.export)
        else:
            for row in analytics.class_histogram(analyses).orderBy(F.desc("n")).collect():
                print(f"{row['classification']}: {row['n']}")
            for row in analytics.best_pages(analyses, pages).orderBy(F.desc("relevance_score")).collect():
                print(f"{row['relevance_score']:.2f} {row['canonical']} {row['title']}")
    else:
        task = runs.read("crawl_goals", args.run).first()
        goal = analyze.Goal(task["prompt"], task["goal_statement"], tuple(task["keywords"]))
        none = "url_key string, goal_id string, prompt_version string, model string"
        known = runs.read("analyses", args.run) if runs.has("analyses") else spark.createDataFrame([], none)
        pages = runs.read("pages", args.run)
        queue = analysis_queue.AnalysisQueue(spark, goal, model)
        queue.step(store.unjudged(pages, known, goal.goal_id, "v1"), pages)
        queue.drain(pages)
        runs.append("analyses", args.run, queue.results())
        print(f"{runs.read('analyses', args.run).count()} analyses")


if __name__ == "__main__":
    main()
