"""A course in a folder: its artifacts by name, and what the commands compute from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import consensus, detect, evaluate, inject, keyword, quality, segment
from lectern.operators.concept_graph import build_edges, build_nodes
from lectern.operators.resolve import resolve
from lectern.sources import course as read
from lectern.sources import sinks

#: Configured courses: early lectures, the first late one, and terms for orphan injections
#: (fixed values); prerequisites may start later.
PLANS = {
    "dataset-1": inject.Plan([2, 3, 4, 5, 6], 7, ["Two-Phase Commit", "Sharding", "Circuit Breaker", "Service Mesh", "Bulkhead", "Leader Election", "Vector Clock", "Write-Ahead Log", "Read-Through Cache"]),
    "dataset-3": inject.Plan([2, 3, 4], 5, ["гейміфікація", "перевернутий клас", "мікронавчання", "конективізм", "скафолдинг", "таксономія Блума", "адаптивне навчання", "сторітелінг", "фасилітація"]),
    "dataset-2": inject.Plan([2, 3, 4, 5, 6], 9, ["скінченний автомат", "формальна граматика", "ентропія", "марковський ланцюг", "матроїд", "мережевий потік", "тюрингова машина", "динамічне програмування", "лямбда-числення"]),
}
PREREQUISITE_LATE = {"dataset-1": 8}
#: Conflict targets picked by hand (fixed values).
PICKED = {
    "dataset-1": ["Aggregate Root", "Anemic Domain Model", "Clean Architecture", "ACID", "Context Map", "Anti-Corruption Layer"],
    "dataset-3": ["акмеологія", "академічна свобода", "бінарна лекція", "Велика дидактика", "вхідний контроль", "вступна лекція"],
}
SPEC = "id string, type string, target string, insert_lecture string, subtlety string, sentence string, insert_unit string"
PAIR_SPEC = "id string, type string, prerequisite string, dependent string, insert_lecture string, subtlety string, sentence string, insert_unit string"
CONFLICT_SPEC = "id string, kind string, concept string, original_definition string, original_lecture string, insert_lecture string, subtlety string"


class Course:
    """Artifacts under root; missing optional files are empty. Results go to root/results."""

    def __init__(self, spark: SparkSession, root: str, overrides: str | None = None):
        self.spark, self.root, self.overrides_path = spark, root.rstrip("/"), overrides
        self.name = self.root.rsplit("/", 1)[-1]

    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def overrides(self) -> DataFrame:
        return read.read_overrides(self.spark, self.overrides_path)

    def lectures(self) -> DataFrame:
        return read.read_lectures(self.spark, self.path("units", "*.json"))

    def manifest(self) -> DataFrame:
        return read.read_manifest(self.spark, self.path("manifest.json"))

    def extractions(self) -> DataFrame:
        return read.read_extractions(self.spark, self.path("extraction", "*.json"))

    def texts(self) -> DataFrame:
        return read.lecture_texts(self.lectures()).join(self.manifest().select("lecture_id", "lecture_order"), "lecture_id")

    def rendered(self) -> DataFrame:
        return segment.render(self.lectures())

    def plan(self, prerequisites: bool = False) -> inject.Plan:
        plan = PLANS.get(self.name, inject.Plan())
        late = PREREQUISITE_LATE.get(self.name, plan.late_min) if prerequisites else plan.late_min
        return inject.Plan(plan.early_orders, late, plan.orphan_terms)

    def segment(self, source: str) -> DataFrame:
        return segment.segment(read.read_markdown(self.spark, source))

    def validate(self) -> DataFrame:
        raw = self.spark.read.text(self.path("extraction", "*.json"), wholetext=True)
        raw = raw.select(F.regexp_replace("_metadata.file_name", r"\.[^.]*\z", "").alias("lecture_id"), "value")
        return quality.validate(raw, self.lectures())

    def resolved(self, extractions: DataFrame | None = None):
        own = self.extractions() if extractions is None else extractions
        return resolve(own.withColumn("spec", F.lit(evaluate.CLEAN)), self.manifest(), self.overrides())

    def graph(self, extractions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        found = self.resolved(extractions)
        nodes = build_nodes(found.concepts, read.unit_texts(self.lectures()))
        return nodes, build_edges(found.prerequisites, nodes)

    def violations(self, transitive: bool = True, max_cycle: int | None = None) -> dict[str, DataFrame]:
        nodes, edges = self.graph()
        report = detect.run_detectors(nodes, edges, transitive, max_cycle)
        ranks = detect.graph_importance(nodes, edges)
        keys = {"used_before_introduction": "concept", "prerequisite_order": "dependent", "definition_conflicts": "concept", "orphan_concepts": "concept"}
        return report | {k: detect.with_importance(report[k], ranks, key) for k, key in keys.items()}

    def consensus(self, min_votes: int = 3) -> DataFrame:
        return consensus.consensus(read.read_runs(self.spark, self.path("dedicated_edges", "*.clean.run*.json")), min_votes)

    def voted(self) -> DataFrame:
        """Extractions with their edges replaced by the votes' outcome."""
        return evaluate.with_edges(self.extractions(), self.consensus())

    def anchored(self) -> DataFrame:
        nodes, edges = self.graph(self.voted())
        return detect.prerequisite_order_anchored(nodes, edges, self.manifest())

    def injections(self, n_used_before: int = 9, n_orphan: int = 9) -> DataFrame:
        nodes, _ = self.graph()
        return inject.make_injections(nodes, self.texts(), detect.used_before_introduction(nodes), self.plan(), n_used_before, n_orphan)

    def prerequisite_injections(self, n: int = 9) -> DataFrame:
        nodes, edges = self.graph()
        return inject.make_prerequisite_injections(nodes, edges, self.texts(), detect.prerequisite_order(nodes, edges), self.plan(True), n)

    def conflicts(self, n: int = 9) -> DataFrame:
        nodes, edges = self.graph()
        return inject.conflict_specs(nodes, detect.graph_importance(nodes, edges), self.manifest(), n)

    def picked_conflicts(self) -> DataFrame:
        return inject.picked_conflicts(self.graph()[0], self.texts(), PICKED.get(self.name, []))

    def reextracted(self, kind: str = "extraction") -> DataFrame:
        """spec, lecture_id, concepts, prerequisites of injections/<id>/<lecture>.<kind>.json."""
        return read.read_injected(self.spark, self.path("injections", "*", f"*.{kind}.json"))

    def keyword(self) -> DataFrame:
        """Terms used before they are defined, or never defined, with their first units."""
        parts = self.rendered().withColumnRenamed("lecture_order", "order")
        units = self.lectures().select("lecture_order", F.col("lecture_id").alias("lecture"), F.posexplode("units").alias("i", "u")).select("lecture_order", "lecture", "i", F.col("u.unit_id").alias("unit"), F.col("u.text").alias("text"))
        return keyword.first_units(keyword.detect_terms(parts), units)

    def forward_refs(self) -> DataFrame:
        nodes, _ = self.graph()
        return detect.forward_ref_cards(nodes, read.unit_texts(self.lectures()))

    def score_concepts(self) -> DataFrame:
        specs = read.read_specs(self.spark, self.path("injections.json"), SPEC).withColumnRenamed("id", "spec")
        every = evaluate.variants(self.extractions(), self.reextracted())
        nodes, _ = evaluate.graphs(every, self.manifest(), read.unit_texts(self.lectures()), self.overrides())
        return evaluate.score_concepts(specs, evaluate.concept_signatures(nodes))

    def score_pairs(self) -> DataFrame:
        specs = read.read_specs(self.spark, self.path("prereq_specs.json"), PAIR_SPEC).withColumnRenamed("id", "spec")
        every = evaluate.variants(self.extractions(), self.reextracted())
        nodes, edges = evaluate.graphs(every, self.manifest(), read.unit_texts(self.lectures()), self.overrides())
        late = detect.prerequisite_order(nodes, edges)
        return evaluate.score_pairs(specs, evaluate.pair_signatures(late), late)

    def score_voted(self, anchored: bool = False) -> DataFrame:
        """Injected votes in place of a lecture's edges, its concepts as they are."""
        specs = read.read_specs(self.spark, self.path("prereq_specs.json"), PAIR_SPEC).withColumnRenamed("id", "spec")
        runs = read.read_runs(self.spark, self.path("injections", "*", "*.dedicated.run*.json"), with_folder=True)
        votes = consensus.consensus(runs, 3, ("spec", "lecture_id")).select("spec", "lecture_id", "prerequisites")
        swapped = votes.join(self.extractions().select("lecture_id", "concepts"), "lecture_id")
        every = evaluate.variants(self.voted(), swapped)
        nodes, edges = evaluate.graphs(every, self.manifest(), read.unit_texts(self.lectures()), self.overrides())
        late = detect.prerequisite_order_anchored(nodes, edges, self.manifest()) if anchored else detect.prerequisite_order(nodes, edges)
        return evaluate.score_pairs(specs, evaluate.pair_signatures(late))

    def conflict_tasks(self) -> DataFrame:
        specs = read.read_specs(self.spark, self.path("conflict_specs.json"), CONFLICT_SPEC).withColumn("spec", F.col("id"))
        every = evaluate.variants(self.extractions(), self.reextracted())
        return evaluate.conflict_tasks(specs, resolve(every, self.manifest(), self.overrides()).concepts)

    def score_minimal(self, anchored: bool = False) -> DataFrame:
        specs = read.read_specs(self.spark, self.path("prereq_specs.json"), PAIR_SPEC).withColumnRenamed("id", "spec")
        clean = self.voted() if anchored else self.extractions()
        every = evaluate.variants(clean, evaluate.with_edge(clean.select("lecture_id", "concepts", "prerequisites"), specs.withColumnRenamed("insert_lecture", "lecture_id")))
        nodes, edges = evaluate.graphs(every, self.manifest(), read.unit_texts(self.lectures()), self.overrides())
        late = detect.prerequisite_order_anchored(nodes, edges, self.manifest()) if anchored else detect.prerequisite_order(nodes, edges)
        return evaluate.score_pairs(specs, evaluate.pair_signatures(late))

    def write(self, df: DataFrame, name: str) -> None:
        sinks.write_json(df, self.path("results", name))
