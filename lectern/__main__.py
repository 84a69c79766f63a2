"""Commands over a course folder: python -m lectern COMMAND --course DIR [...].

segment --src   validate   graph   detect [--no-transitive] [--max-cycle]   vocabulary   consensus
[--min-votes]   audit --decisions   forward-refs   inject   inject-prerequisites   conflicts
picked-conflicts   apply --sentences   keyword   score   score-prerequisites   score-minimal
score-voted   anchored   conflict-tasks   statistics --counts
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from lectern.course import CONFLICT_SPEC, Course
from lectern.operators import evaluate, inject, quality, segment
from lectern.session import session
from lectern.sources import course as read
from lectern.sources import sinks


def main(args: list[str] | None = None, spark=None) -> int:
    ap = argparse.ArgumentParser(prog="lectern", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    ap.add_argument("command")
    ap.add_argument("--course", default="dataset-1")
    for name in ("--src", "--overrides", "--decisions", "--sentences", "--counts"):
        ap.add_argument(name)
    ap.add_argument("--no-transitive", action="store_true")
    ap.add_argument("--dry-run", action="store_true")
    ap.add_argument("--anchored", action="store_true")
    ap.add_argument("--max-cycle", type=int, default=None)
    ap.add_argument("--min-votes", type=int, default=3)
    for name in ("--n", "--n-used-before", "--n-orphan"):
        ap.add_argument(name, type=int, default=9)
    a = ap.parse_args(args)
    spark = spark or session()
    own = Course(spark, a.course, a.overrides)
    made = {
        "forward-refs": own.forward_refs, "inject": lambda: own.injections(a.n_used_before, a.n_orphan), "inject-prerequisites": lambda: own.prerequisite_injections(a.n), "conflicts": lambda: own.conflicts(a.n),
        "picked-conflicts": own.picked_conflicts, "keyword": own.keyword, "consensus": lambda: own.consensus(a.min_votes), "score": own.score_concepts, "score-prerequisites": own.score_pairs,
        "score-minimal": lambda: own.score_minimal(a.anchored), "score-voted": lambda: own.score_voted(a.anchored), "anchored": own.anchored, "conflict-tasks": own.conflict_tasks,
    }
    if a.command in made:
        own.write(made[a.command](), a.command)
    elif a.command == "segment":
        lectures = own.segment(a.src)
        sinks.write_lectures(lectures, own.path("results", "units"))
        sinks.write_rendered(segment.render(lectures), own.path("results", "rendered"))
        sinks.write_manifest(segment.manifest(lectures), own.path("results", "manifest"))
    elif a.command == "validate":
        issues = own.validate()
        own.write(issues, "issues")
        return int(not quality.verdict(issues, own.lectures()).where("not valid").isEmpty())
    elif a.command == "graph":
        nodes, edges = own.graph()
        sinks.write_graph(nodes, edges, own.path("results", "graph"))
        sinks.write_json(sinks.node_link(nodes, edges), own.path("results", "node_link"))
        sinks.write_graphml(nodes, edges, own.path("results", "graphml"))
    elif a.command == "detect":
        sinks.write_report(own.violations(not a.no_transitive, a.max_cycle), own.path("results", "violations"))
    elif a.command == "vocabulary":
        sinks.write_vocabulary(own.graph()[0], own.path("results", "vocabulary"))
    elif a.command == "audit":
        decisions = spark.read.schema(read.OVERRIDES).option("multiLine", True).json(a.decisions)
        merged, change = evaluate.audit(own.extractions().withColumn("spec", F.lit(evaluate.CLEAN)), own.manifest(), read.unit_texts(own.lectures()), own.overrides(), decisions)
        if not a.dry_run:
            own.write(change, "orphan_delta")
            sinks.write_overrides(merged, own.path("results", "overrides"))
    elif a.command == "apply":
        specs = read.read_specs(spark, own.path("conflict_specs.json"), CONFLICT_SPEC)
        specs = inject.with_sentences(specs, read.read_sentences(spark, a.sentences), own.name)
        sinks.write_injected(inject.apply(specs, own.rendered(), own.lectures()), own.path("results", "injected"))
    elif a.command == "statistics":
        own.write(evaluate.statistics(*read.read_counts(spark, a.counts)), "statistics")
    else:
        ap.error(f"unknown command {a.command}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
