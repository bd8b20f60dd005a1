"""Steps of a plan kept as tables, each under the state of the files it was made from.

A step's table is found by the step's name, its folder of input tables, and the identity of the files in it:
path, length and time of each. A changed, added or removed file gives another identity, so that a step is made
anew; a later session finds what an earlier one made. A manifest, put in place by one rename after its table is
whole, is what makes a version be there, so that a lost driver leaves no half version behind.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.sources.files import Folder, identity
from tidemark.sources.shared import shared_dir

Step = Callable[[SparkSession, str], DataFrame]
#: Versions of a step that are left when a new one is put in place; older ones go once superseded for ``GRACE`` seconds.
KEEP, GRACE = 2, 3600.0

_now = threading.local()


@contextmanager
def _inputs(spark: SparkSession, d: str, tables: tuple[str, ...]):
    """The identity of the input tables; steps made on the way to another see the state that one began with."""
    held = getattr(_now, "held", None)
    if held is not None and held[0] == (d, tables):
        yield held[1]
        return
    _now.held = ((d, tables), identity(spark, [f"{d}/{t}.parquet" for t in tables]))
    try:
        yield _now.held[1]
    finally:
        _now.held = held


def _home(spark: SparkSession, d: str, name: str) -> Folder:
    return Folder(spark, f"{shared_dir(spark)}/tidemark/steps/{hashlib.sha256(d.encode()).hexdigest()[:16]}/{name}")


def reap(home: Folder, keep: int = KEEP, grace: float = GRACE) -> int:
    """Drop versions but the ``keep`` latest, if superseded for ``grace`` seconds; the number of those dropped."""
    found = sorted(((t, n) for n, t in home.names() if n.endswith(".json")), reverse=True)
    gone = 0
    for (newer, _), (_, name) in zip(found[keep - 1 :], found[keep:]):
        if time.time() - newer / 1000 >= grace:
            manifest = json.loads(home.read(name) or "{}")
            home.drop(name)  # first the manifest, so that nobody finds a table that goes
            if "table" in manifest:
                home.drop(manifest["table"])
            gone += 1
    return gone


def stored(*tables: str, version: str = "1") -> Callable[[Step], Step]:
    """A step over ``tables`` of a folder, made when its table for their present state isn't there. ``version`` is the step's own."""

    def wrap(step: Step) -> Step:
        @wraps(step)
        def read(spark: SparkSession, d: str) -> DataFrame:
            with _inputs(spark, d, tables) as state:
                home, key = _home(spark, d, step.__name__), f"{version}-{state}.json"
                found = home.read(key)
                if found is None:
                    made = step(spark, d)
                    table = f"table-{uuid.uuid4().hex}"
                    made.write.parquet(f"{home.path}/{table}")
                    if not home.put(key, json.dumps({"table": table, "schema": made.schema.jsonValue(), "inputs": state}), f"{table}.tmp"):
                        home.drop(table)  # another session was first
                    found = home.read(key)
                    reap(home)
            manifest = json.loads(found)
            return spark.read.schema(T.StructType.fromJson(manifest["schema"])).parquet(f"{home.path}/{manifest['table']}")

        return read

    return wrap


def forget(spark: SparkSession, d: str) -> None:
    """Drop all stored steps of a folder of input tables."""
    Folder(spark, f"{shared_dir(spark)}/tidemark/steps").drop(hashlib.sha256(d.encode()).hexdigest()[:16])
