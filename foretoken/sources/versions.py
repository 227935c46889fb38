"""Tables that change in one step: a write makes a new folder, then one small file says it is live.

The small files are numbered from 1 below ``_live``. A reader takes the newest and opens the folders
that it names; nothing it opens is ever written again, so a reader, or a run that ends half way, sees
the old rows or the new ones. What the newest two files do not name is deleted after a switch: who
began to read before it may finish. A table has one writer at a time; if two meet, the later switch
is an error and leaves the table as it is.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foretoken.session import create_file, folder_exists, list_folder, read_file, remove_folder

LIVE = "_live"
# Newest states whose folders are kept.
KEPT = 2


def new_folder() -> str:
    return f"v-{uuid.uuid4().hex}"


def live_number(spark: SparkSession, path: str) -> int:
    """How often the table was switched; 0 if it never was."""
    return max((int(name) for name in list_folder(spark, f"{path}/{LIVE}") if name.isdigit()), default=0)


def live_state(spark: SparkSession, path: str, number: int | None = None):
    """What the newest switch, or switch ``number``, said; None before the first."""
    number = live_number(spark, path) if number is None else number
    return json.loads(read_file(spark, f"{path}/{LIVE}/{number}")) if number else None


def switch(
    spark: SparkSession, path: str, seen: int, state, folders_of: Callable[[object], list[str]]
) -> None:
    """Make ``state`` the table's, if switch ``seen`` is still the newest, then delete what no kept
    state names. ``folders_of`` lists the folders that a state names."""
    if not create_file(spark, f"{path}/{LIVE}/{seen + 1}", json.dumps(state)):
        raise RuntimeError(f"{path} was changed by another writer")
    first_kept = max(1, seen + 2 - KEPT)
    named = {f for k in range(first_kept, seen + 2) for f in folders_of(live_state(spark, path, k))}
    for name in list_folder(spark, path):
        if name.startswith("v-") and name not in named:
            remove_folder(spark, f"{path}/{name}")
    for name in list_folder(spark, f"{path}/{LIVE}"):
        if not name.isdigit() or int(name) < first_kept:
            remove_folder(spark, f"{path}/{LIVE}/{name}")


def replace(spark: SparkSession, path: str, write: Callable[[str], object]) -> None:
    """Create or replace the table at ``path`` by what ``write`` puts into the folder it is given.

    If ``write`` fails, the table stays as it was.
    """
    seen = live_number(spark, path)
    folder = new_folder()
    write(f"{path}/{folder}")
    switch(spark, path, seen, folder, lambda state: [state])


def live_path(spark: SparkSession, path: str) -> str:
    """The folder that holds the table's rows now: one below ``path``, or ``path`` itself if it was
    written without :func:`replace`."""
    folder = live_state(spark, path)
    if folder is None:
        if not folder_exists(spark, path):
            raise FileNotFoundError(path)
        return path
    return f"{path}/{folder}"


def read_live(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(live_path(spark, path))
