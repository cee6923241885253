"""Commands: python -m pointloom.cli VERB PROJECT ..."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from pointloom.errors import PointError
from pointloom.plans.project import PointProject
from pointloom.sources import demo


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pointloom")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, text: str, *more: tuple) -> None:
        v = verbs.add_parser(name, help=text)
        v.add_argument("project")
        for flag, options in more:
            v.add_argument(flag, **options)

    verb("demo", "a new project with two generated scans")
    verb("import", "add the scans of LAS and E57 files and panoramas (JPEG, PNG), to a new project if there is none", ("files", {"nargs": "+"}))
    verb("inspect", "scans, records and points by layer")
    verb("export", "write an E57 file", ("target", {}))
    verb("export-las", "write a LAS file, or one for each scan", ("target", {}), ("--each", {"action": "store_true"}), ("--omit-incompatible", {"action": "store_true"}))
    verb("subsample", "thin each scan", ("size", {"type": float}))
    verb("subsample-merged", "thin all scans together", ("size", {"type": float}))
    verb("reduce-overlap", "keep the denser scan", ("--size", {"type": float, "default": 0.1}))
    verb("noise", "points with few neighbours", ("--radius", {"type": float, "default": 0.05}), ("--neighbours", {"type": int, "default": 4}))
    verb("sor", "points far from their neighbours", ("--neighbours", {"type": int, "default": 6}), ("--deviations", {"type": float, "default": 1.0}), ("--reach", {"type": float, "default": 0.5}))
    verb("moving", "points that other scans saw past", ("--degrees", {"type": float, "default": 0.1}), ("--tolerance", {"type": float, "default": 0.05}), ("--scans", {"type": int, "default": 2}))
    return p


def run(spark: SparkSession, args: list[str]) -> list[str]:
    """Runs a command and returns its lines."""
    a = parser().parse_args(args)
    if a.verb == "demo":
        with PointProject.create(spark, a.project) as project:
            return [f"scan {s}" for s in project.import_points(demo.demo_scans(spark))]
    fresh = a.verb == "import" and not os.path.exists(f"{a.project}/project.json")
    with PointProject.create(spark, a.project) if fresh else PointProject.load(spark, a.project) as project:
        return answer(project, a)


def answer(project: PointProject, a: argparse.Namespace) -> list[str]:
    h = project.history
    moved = lambda n: [f"{n} points moved"]
    if a.verb == "import":
        picture = lambda f: f.lower().endswith((".jpg", ".jpeg", ".png"))
        return [line for f in a.files for line in ([f"panorama {project.import_panorama(f).id}"] if picture(f) else [f"scan {s}" for s in project.import_file(f)])]
    if a.verb == "inspect":
        names = {x.code: x.name for x in h.current.layers}
        scans = [f"{h.name_of(s)}: {h.known[s].records} records, {h.known[s].valid} valid" for s in h.current.scans]
        return scans + [f"{names[r['code']]}: {r['n']}" for r in project.layer_counts().orderBy("code").collect()]
    if a.verb == "export":
        return [f"{project.export_e57(a.target)} records written"]
    if a.verb == "export-las":
        return [f"{project.export_las(a.target, not a.each, a.omit_incompatible)} points written"]
    if a.verb == "subsample":
        return moved(project.subsample(a.size))
    if a.verb == "subsample-merged":
        return moved(project.subsample_merged(a.size))
    if a.verb == "reduce-overlap":
        return moved(project.reduce_overlap(a.size))
    if a.verb == "noise":
        return moved(project.remove_noise(a.radius, a.neighbours))
    if a.verb == "sor":
        return moved(project.remove_outliers(a.neighbours, a.deviations, a.reach))
    return moved(project.remove_moving(a.degrees, a.tolerance, a.scans))


def main() -> int:
    spark = SparkSession.builder.appName("pointloom").getOrCreate()
    try:
        print("\n".join(run(spark, sys.argv[1:])))
    except PointError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
