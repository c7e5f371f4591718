"""lexispark: language analytics of text on PySpark."""

from __future__ import annotations

import os
import tempfile
import zipfile

__version__ = "0.2.0"
_FRONT = ("detect", "detect_batch", "ensemble", "default_detector", "reset_default")


def __getattr__(name: str):
    """The front doors, imported when they are first used."""
    if name in _FRONT:
        from .plans import front

        return getattr(front, name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")


def ship(spark) -> None:
    """Gives executors this package, once for each Spark application, where it isn't installed on them."""
    context = spark.sparkContext
    if getattr(context, "_lexispark_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lexispark-"), "lexispark_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if not name.endswith(".pyc"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
    context._lexispark_shipped = True
