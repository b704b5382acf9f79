"""python -m nestlake.scripts.derive {projection,structures,pivot} PATTERN OUT [--level PATH] [--id NAME] [--force]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..functions.chem import available
from ..operators import projection, structures
from ..operators.pivot import pivot
from ..plans.artifacts import derive_tree


def main(argv: list[str] | None = None) -> int:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("kind", choices=("projection", "structures", "pivot"))
    args.add_argument("pattern")
    args.add_argument("out")
    args.add_argument("--level")
    args.add_argument("--id", default="record_id")
    args.add_argument("--force", action="store_true")
    a = args.parse_args(argv)
    spark = SparkSession.builder.appName(f"derive {a.kind}").getOrCreate()
    if a.kind == "pivot" and not a.level:
        args.error("a pivot needs --level")
    make = {
        "projection": projection.projected,
        "structures": lambda df: structures.structures(df, available()),
        "pivot": lambda df: pivot(df, a.level, a.id),
    }[a.kind]
    parent = None if a.kind == "projection" else "projection"
    name = a.kind if a.kind != "pivot" else f"pivot:{a.level}"
    written, skipped, ignored = derive_tree(spark, a.pattern, a.out, name, "1", make, force=a.force, parent=parent)
    print(f"written {len(written)}, skipped {len(skipped)}, ignored {len(ignored)}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
