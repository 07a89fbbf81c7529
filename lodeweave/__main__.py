"""python -m lodeweave USER --tables FOLDER: what to recommend to a user, printed and logged.

FOLDER holds the tables movie and user_rating as Parquet, as `sources.schemas.store` writes them.
"""

from __future__ import annotations

import argparse
import logging
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import collaborative, quality
from .session import PROFILES, session
from .sources import files, sinks

logger = logging.getLogger("lodeweave")


def logs_to(path: str | None = None, level: str = "INFO") -> None:
    """Messages go to the console, and to a file if one is named."""
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if path:
        handlers.append(logging.FileHandler(path, encoding="utf-8"))
    for h in handlers:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    logger.handlers[:] = handlers
    logger.setLevel(level)


def recommend(spark: SparkSession, folder: str, user_id: int, top_n: int = 3, log: str | None = None, explain: bool = False) -> list[str]:
    """Titles for a user, best first; a line is added to the text log at `log`."""
    user_id, top_n = quality.bounded(user_id, top_n)
    ratings = files.table(spark, folder, "user_rating").select(F.col("userID").cast("long").alias("user_id"), F.col("movie_id").alias("item_id"), "score")
    items = files.table(spark, folder, "movie").select(F.col("id").alias("item_id"), F.col("eng_title").alias("title"), "votes", "revenue")
    known = ratings.join(items.select("item_id"), "item_id", "left_semi").groupBy("user_id", "item_id").agg(F.avg("score").alias("score"))
    started = time.time()
    best = collaborative.recommend(known, items, user_id, top_n)
    if explain:
        best.explain("formatted")
    titles = [r["title"] for r in sorted(best.collect(), key=lambda r: r["position"])]
    logger.info("user %d: %d titles in %.1f s", user_id, len(titles), time.time() - started)
    if log and titles:
        sinks.log(sinks.result_lines(best, top_n), log)
    return titles


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lodeweave", description=__doc__)
    p.add_argument("user_id", type=int)
    p.add_argument("--tables", required=True, help="folder of the tables")
    p.add_argument("--top_n", type=int, default=3)
    p.add_argument("--log", help="folder of the text log of results")
    p.add_argument("--messages", help="file for messages")
    p.add_argument("--profile", action="store_true", help="print the plan and the time it took")
    p.add_argument("--environment", choices=sorted(PROFILES), default="production")
    p.add_argument("--master")
    a = p.parse_args(args)
    logs_to(a.messages)
    titles = recommend(session(profile=a.environment, master=a.master), a.tables, a.user_id, a.top_n, a.log, a.profile)
    print(f"Recommended for user {a.user_id}: {', '.join(titles)}")


if __name__ == "__main__":
    main()
