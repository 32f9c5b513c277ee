"""Remediation plans, effort totals, finding summaries and report texts per run."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import messages
from plumbline.functions.grades import (
    EFFORT_CONFIDENCE,
    SEVERITY_WEIGHTS,
    choose,
    effort_max,
    effort_min,
    finding_id,
    severity_rank,
)
from plumbline.functions.text import fill, fixed, rounded, spaced, titled
from plumbline.operators.dependencies import entity_topic, gap_topic
from plumbline.operators.ranking import number_rows

# Priority and effort level of an item by the severity of its finding.
SCHEMA_PRIORITY = {"CRITICAL": 10, "HIGH": 8, "MEDIUM": 5, "LOW": 3, "INFO": 1}
SCHEMA_EFFORT = {"CRITICAL": "HIGH", "HIGH": "MEDIUM", "MEDIUM": "LOW", "LOW": "TRIVIAL", "INFO": "TRIVIAL"}
BOTTLENECK_PRIORITY = {"CRITICAL": 9, "HIGH": 7, "MEDIUM": 5, "LOW": 2}
GAP_PRIORITY = {"CRITICAL": 10, "HIGH": 8, "MEDIUM": 6, "LOW": 3}

CATEGORIES = ["schema", "pipeline", "middleware", "data_quality"]  # by kind_ord
PARALLEL_DISCOUNT = 0.70


def _or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _related(df: DataFrame, kind: str, column: str = "finding_id") -> Column:
    """The id of the finding: its own, or else a hash of run, kind and place."""
    return F.col(column) if column in df.columns else finding_id(F.col("run_id"), F.lit(kind), F.col("input_ord"))


def _schema_topic() -> Column:
    return entity_topic(_or_empty(F.col("entity_name")))


def _pipeline_topic() -> Column:
    return F.concat(F.lit("pipeline:"), _or_empty(F.col("system")))


def _middleware_topic() -> Column:
    return gap_topic(F.col("gap_type"))


def _quality_topic() -> Column:
    return F.lit("quality")


TOPICS = [_schema_topic, _pipeline_topic, _middleware_topic, _quality_topic]  # by kind_ord


def item_id(run_id: Column, kind_ord: Column, input_ord: Column) -> Column:
    """The id of an item: a hash of its run, category and place."""
    return finding_id(run_id, F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), kind_ord + 1), input_ord)


def _items(df: DataFrame, kind: int, **values: Column) -> DataFrame:
    category = CATEGORIES[kind]
    none = F.array().cast("array<string>")
    c = {"severity": F.col("severity"), "confidence": F.lit(EFFORT_CONFIDENCE), "related": none, **values}
    return df.select(
        "run_id",
        F.lit(kind).alias("kind_ord"),
        F.col("input_ord").cast("long").alias("input_ord"),
        item_id(F.col("run_id"), F.lit(kind), F.col("input_ord")).alias("item_id"),
        c["title"].alias("title"),
        c["description"].alias("description"),
        F.lit(category).alias("category"),
        c["priority"].alias("priority"),
        c["severity"].alias("severity"),
        c["low"].alias("effort_min_days"),
        c["high"].alias("effort_max_days"),
        c["confidence"].alias("confidence"),
        c["related"].alias("related_gap_ids"),
        c["topic"].alias("topic"),
    )


def schema_items(findings: DataFrame) -> DataFrame:
    """Items of schema findings: ``kind``, ``entity_name``, ``field_name``, hint and impact texts."""
    severity = F.col("severity")
    level = choose(severity, SCHEMA_EFFORT, "MEDIUM")
    field = _or_empty(F.col("field_name"))
    title = F.concat(
        fill(messages.SCHEMA_TITLE, kind=spaced(F.col("kind")), entity=F.col("entity_name")),
        F.when(field != "", F.concat(F.lit("."), field)).otherwise(""),
    )
    hint = _or_empty(F.col("remediation_hint"))
    return _items(
        findings, 0,
        title=title,
        description=F.when(hint != "", hint).otherwise(_or_empty(F.col("impact_description"))),
        priority=choose(severity, SCHEMA_PRIORITY, 5),
        low=effort_min(level),
        high=effort_max(level),
        related=F.array(_related(findings, "schema_finding")),
        topic=_schema_topic(),
    )


def bottleneck_items(bottlenecks: DataFrame) -> DataFrame:
    """Items of pipeline bottlenecks."""
    return _items(
        bottlenecks, 1,
        title=fill(
            messages.BOTTLENECK_TITLE,
            kind=spaced(F.col("bottleneck_type")),
            pipeline=F.col("pipeline_name"),
            system=F.col("system"),
        ),
        description=fill(
            messages.BOTTLENECK_TEXT,
            description=F.col("description"),
            observed=F.col("observed_value"),
            threshold=F.col("threshold_value"),
            unit=F.col("unit"),
        ),
        priority=choose(F.col("severity"), BOTTLENECK_PRIORITY, 5),
        low=effort_min(F.lit("MEDIUM")),
        high=effort_max(F.lit("MEDIUM")),
        related=F.array(_related(bottlenecks, "bottleneck")),
        topic=_pipeline_topic(),
    )


def gap_items(gaps: DataFrame) -> DataFrame:
    """Items of integration gaps; a blocking gap moves up by one, to 10 at most."""
    raised = choose(F.col("severity"), GAP_PRIORITY, 6) + F.when(F.col("blocking"), 1).otherwise(0)
    return _items(
        gaps, 2,
        title=fill(
            messages.GAP_TITLE, kind=spaced(F.col("gap_type")), source=F.col("source_system"), target=F.col("target_system")
        ),
        description=fill(
            messages.GAP_TEXT, description=F.col("description"), solution=_or_empty(F.col("recommended_solution"))
        ),
        priority=F.least(F.lit(10), raised),
        low=F.col("effort_min"),
        high=F.col("effort_max"),
        related=F.array(_related(gaps, "gap", "gap_id")),
        topic=_middleware_topic(),
    )


def quality_items(issues: DataFrame) -> DataFrame:
    """Items of quality issues; missing titles are numbered in input order per run."""
    def given(name: str) -> Column:
        return F.col(name) if name in issues.columns else F.lit(None)

    numbered = number_rows(issues, ["run_id"], "input_ord", name="issue_number")
    default_title = fill(messages.QUALITY_TITLE, number=F.col("issue_number"))
    return _items(
        numbered, 3,
        title=F.coalesce(given("title").cast("string"), default_title),
        description=_or_empty(given("description").cast("string")),
        priority=F.coalesce(given("priority").cast("int"), F.lit(4)),
        severity=F.coalesce(F.col("severity"), F.lit("MEDIUM")),
        low=effort_min(F.lit("LOW")),
        high=effort_max(F.lit("LOW")),
        topic=_quality_topic(),
    )


def plan_items(
    findings: DataFrame | None = None,
    bottlenecks: DataFrame | None = None,
    gaps: DataFrame | None = None,
    quality_issues: DataFrame | None = None,
) -> DataFrame:
    """All items, not yet ordered. Every input has ``run_id`` and a ``input_ord`` unique in its run."""
    builders = [schema_items, bottleneck_items, gap_items, quality_items]
    inputs = [findings, bottlenecks, gaps, quality_issues]
    return reduce(DataFrame.unionByName, [build(df) for build, df in zip(builders, inputs) if df is not None])


def plan_topics(
    findings: DataFrame | None = None,
    bottlenecks: DataFrame | None = None,
    gaps: DataFrame | None = None,
    quality_issues: DataFrame | None = None,
) -> DataFrame:
    """(run_id, topic) of all items; rows may repeat. Of each input only the columns that name its topic are read."""
    inputs = [findings, bottlenecks, gaps, quality_issues]
    return reduce(DataFrame.unionByName, [df.select("run_id", topic().alias("topic")) for df, topic in zip(inputs, TOPICS) if df is not None])


def remediation_plan(items: DataFrame) -> DataFrame:
    """Items numbered per run: priority, then severity, then kind and input order."""
    return number_rows(
        items,
        ["run_id"],
        "input_ord",
        [-F.col("priority"), -choose(F.col("severity"), SEVERITY_WEIGHTS, 3), F.col("kind_ord")],
        "recommended_sequence",
    )


def remediation_effort(items: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Total effort per run, less 30 % for work done in parallel.

    Days are truncated on the floating-point product, so 90 days give 62.
    """
    def discounted(total: Column) -> Column:
        return F.greatest(F.lit(0), F.floor(total * F.lit(PARALLEL_DISCOUNT)))

    confidence = F.col("confidence_sum").cast("double") / F.col("item_count")
    totals = items.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("item_count"),
        discounted(F.sum("effort_min_days")).alias("min_days"),
        discounted(F.sum("effort_max_days")).alias("max_days"),
        # A decimal sum is the same for every order of rows.
        F.sum(F.col("confidence").cast("decimal(10,6)")).alias("confidence_sum"),
    )
    if runs is not None:
        totals = runs.select("run_id").distinct().join(totals, "run_id", "left")
    high = F.col("max_days")
    level = (
        F.when(high <= 1, "TRIVIAL").when(high <= 5, "LOW").when(high <= 21, "MEDIUM").when(high <= 90, "HIGH").otherwise("CRITICAL")
    )
    empty = F.col("item_count").isNull()
    return totals.select(
        "run_id",
        F.coalesce("item_count", F.lit(0)).alias("item_count"),
        F.coalesce("min_days", F.lit(0)).alias("min_days"),
        F.coalesce("max_days", F.lit(1)).alias("max_days"),
        F.when(empty, "TRIVIAL").otherwise(level).alias("effort_level"),
        F.when(empty, F.lit(EFFORT_CONFIDENCE)).otherwise(rounded(confidence, 2)).alias("confidence"),
    )


def _tagged(
    findings: DataFrame, bottlenecks: DataFrame, gaps: DataFrame, quality_issues: DataFrame, runs: DataFrame | None = None
) -> DataFrame:
    """All findings with their kind; a row without kind for each run of the list, so that none is missing."""
    no, none = F.lit(False), F.lit(None).cast("string")
    listed = [] if runs is None else [runs.select("run_id", none.alias("kind"), none.alias("severity"), no.alias("blocking"))]
    return reduce(
        DataFrame.unionByName,
        [
            *listed,
            findings.select("run_id", F.lit("schema").alias("kind"), "severity", no.alias("blocking")),
            bottlenecks.select("run_id", F.lit("pipeline").alias("kind"), "severity", no.alias("blocking")),
            gaps.select("run_id", F.lit("middleware").alias("kind"), "severity", "blocking"),
            quality_issues.select("run_id", F.lit("data_quality").alias("kind"), "severity", no.alias("blocking")),
        ],
    )


def finding_totals(findings: DataFrame, bottlenecks: DataFrame, gaps: DataFrame, quality_issues: DataFrame) -> DataFrame:
    """Findings per run, kind and severity with all subtotals; ``all`` stands where a subtotal covers every value.

    Rows are counted per (run, kind, severity) first, so that grouping sets multiply a few counts per run and not its rows.
    """
    severity = F.coalesce("severity", F.lit("unknown"))
    tagged = _tagged(findings, bottlenecks, gaps, quality_issues).withColumn("severity", severity)
    counts = tagged.groupBy("run_id", "kind", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_if("blocking").alias("b"))
    sets = [["run_id", "kind", "severity"], ["run_id", "kind"], ["run_id", "severity"], ["run_id"]]
    totals = counts.groupingSets([[F.col(c) for c in s] for s in sets], "run_id", "kind", "severity")
    shown = lambda c: F.when(F.grouping(c) == 1, F.lit("all")).otherwise(F.col(c)).alias(f"shown_{c}")
    found = totals.agg(F.sum("n").alias("finding_count"), F.sum("b").alias("blocking_count"), shown("kind"), shown("severity"))
    return found.select("run_id", F.col("shown_kind").alias("kind"), F.col("shown_severity").alias("severity"), "finding_count", "blocking_count")


def findings_summary(
    findings: DataFrame, bottlenecks: DataFrame, gaps: DataFrame, quality_issues: DataFrame, runs: DataFrame | None = None
) -> DataFrame:
    """Six counts per run, in one aggregation over all finding kinds; zeros for listed ``runs`` without findings."""
    kind = F.col("kind")
    critical = (F.col("severity") == "CRITICAL") & (kind != "data_quality")
    return _tagged(findings, bottlenecks, gaps, quality_issues, runs).groupBy("run_id").agg(
        F.count_if(kind == "schema").alias("schema_inconsistencies"),
        F.count_if(kind == "pipeline").alias("pipeline_bottlenecks"),
        F.count_if(kind == "middleware").alias("middleware_gaps"),
        F.count_if(kind == "data_quality").alias("data_quality_issues"),
        F.count_if(critical).alias("critical_issues"),
        F.count_if("blocking").alias("blocking_gaps"),
    )


def severity_breakdown(
    findings: DataFrame, bottlenecks: DataFrame, gaps: DataFrame, quality_issues: DataFrame, runs: DataFrame | None = None
) -> DataFrame:
    """Counts per run, kind and severity with subtotals per kind (null severity).

    Listed ``runs`` have a subtotal for every kind, zero where nothing was found.
    """
    keys = ["run_id", "kind", "severity"]
    found = _tagged(findings, bottlenecks, gaps, quality_issues).select(*keys, F.lit(1).alias("one"))
    if runs is not None:
        kinds = F.explode(F.array(*[F.lit(k) for k in messages.TECHNICAL_KINDS]))
        found = found.unionByName(runs.select("run_id", kinds.alias("kind"), F.lit(None).cast("string").alias("severity"), F.lit(0).alias("one")))
    fine = found.groupBy(*keys).agg(F.sum("one").alias("n"))
    return (
        fine.groupingSets([keys, keys[:2]], *keys)
        .agg(F.sum("n").alias("n"), F.grouping("severity").alias("g"))
        .select(*keys, "n", (F.col("g") == 1).alias("is_total"))
        .filter("is_total OR n > 0")
    )


def technical_summary(
    findings: DataFrame, bottlenecks: DataFrame, gaps: DataFrame, quality_issues: DataFrame, runs: DataFrame | None = None
) -> DataFrame:
    """Text with the counts per kind; lines of severities without findings are left out."""
    levels = {"schema": ["CRITICAL", "HIGH", "MEDIUM", "LOW"], "pipeline": ["CRITICAL", "HIGH", "MEDIUM"]}
    kinds = messages.TECHNICAL_KINDS
    kind, severity = F.col("kind"), F.col("severity")
    counts = _tagged(findings, bottlenecks, gaps, quality_issues, runs).groupBy("run_id").agg(
        *[F.count_if(kind == k).alias(k) for k in kinds],
        *[F.count_if((kind == k) & (severity == s)).alias(f"{k}_{s}") for k, ss in levels.items() for s in ss],
        F.count_if("blocking").alias("blocking_count"),
    )
    lines: list[Column] = [F.lit(messages.TECHNICAL_HEAD), F.lit("")]
    for k, label in kinds.items():
        lines.append(fill(label, n=F.col(k)))
        for s in levels.get(k, []):
            n = F.col(f"{k}_{s}")
            lines.append(F.when(n > 0, F.concat(F.lit(f"  {s:8s}: "), n.cast("string"))))
        if k == "middleware":
            n = F.col("blocking_count")
            lines.append(F.when(n > 0, fill(messages.TECHNICAL_BLOCKING, n=n)))
    return counts.select("run_id", F.concat_ws("\n", *lines).alias("technical_summary"))


def simple_plan(findings: DataFrame, gaps: DataFrame, include_high: bool = False) -> DataFrame:
    """Short plan: each blocking gap, then one item for all critical schema findings.

    ``include_high`` adds one item for all HIGH schema findings.
    """
    gap_items_ = number_rows(gaps.filter("blocking"), ["run_id"], "gap_ord", name="recommended_sequence").select(
        "run_id",
        F.concat(F.lit("rem_"), F.col("gap_id")).alias("id"),
        fill(messages.SHORT_GAP_TITLE, kind=titled(F.col("gap_type"))).alias("title"),
        "description",
        F.lit("middleware").alias("category"),
        F.when(F.col("severity") == "CRITICAL", 9).otherwise(7).alias("priority"),
        F.coalesce("severity", F.lit("HIGH")).alias("severity"),
        F.coalesce("effort_min", F.lit(5)).cast("long").alias("effort_min_days"),
        F.coalesce("effort_max", F.lit(20)).cast("long").alias("effort_max_days"),
        F.col("recommended_sequence").cast("long").alias("recommended_sequence"),
    )
    zero = F.lit(0)
    counts = (
        findings.select("run_id", (F.col("severity") == "CRITICAL").cast("int").alias("critical"), (F.col("severity") == "HIGH").cast("int").alias("high"), zero.alias("blocking"))
        .unionByName(gaps.select("run_id", zero.alias("critical"), zero.alias("high"), F.col("blocking").cast("int").alias("blocking")))
        .groupBy("run_id")
        .agg(F.sum("critical").alias("critical"), F.sum("high").alias("high"), F.coalesce(F.sum("blocking"), zero).alias("blocking"))
    )

    def grouped(name: str, texts: tuple[str, str], priority: int, low: int, high: int, after: Column) -> Column:
        n = F.col(name)
        return F.when(
            n > 0,
            F.struct(
                F.lit(f"rem_schema_{name}").alias("id"),
                F.lit(texts[0]).alias("title"),
                fill(texts[1], n=n).alias("description"),
                F.lit("schema").alias("category"),
                F.lit(priority).alias("priority"),
                F.lit(name.upper()).alias("severity"),
                (n * low).alias("effort_min_days"),
                (n * high).alias("effort_max_days"),
                (after + 1).cast("long").alias("recommended_sequence"),
            ),
        )

    wanted = [grouped("critical", messages.SHORT_CRITICAL, 10, 3, 7, F.col("blocking"))]
    if include_high:
        after = F.col("blocking") + (F.col("critical") > 0).cast("int")
        wanted.append(grouped("high", messages.SHORT_HIGH, 8, 2, 5, after))
    schema_items_ = counts.select("run_id", F.inline(F.array_compact(F.array(*wanted))))
    return gap_items_.unionByName(schema_items_)


def executive_summary(scores: DataFrame, summary: DataFrame, assessed_on: str) -> DataFrame:
    """Summary text of the weighted scorer.

    ``scores`` comes from ``readiness``; ``summary`` has, per run, ``schema_inconsistencies``,
    ``critical_schema``, ``pipeline_bottlenecks``, ``middleware_gaps`` and ``blocking_gaps``;
    ``assessed_on`` is the date text shown.
    """
    c = F.col
    counts = ["schema_inconsistencies", "critical_schema", "pipeline_bottlenecks", "middleware_gaps", "blocking_gaps"]
    joined = scores.join(summary.select("run_id", *counts), "run_id", "left").na.fill(0, counts)
    weeks = c("remediation_weeks")

    def shown(name: str, template: str, **values: Column) -> Column:
        return F.when(c(name) > 0, fill(template, n=c(name), **values))

    lines = [
        fill(messages.SUMMARY_HEAD, score=fixed(c("overall_score"), 0), verdict=spaced(c("verdict"))),
        F.lit(""),
        choose(c("verdict"), messages.VERDICT_INTROS, messages.OTHER_INTRO),
        F.lit(""),
        shown(
            "schema_inconsistencies", messages.SUMMARY_SCHEMA, critical=_or_empty(shown("critical_schema", messages.SUMMARY_CRITICAL))
        ),
        shown("pipeline_bottlenecks", messages.SUMMARY_PIPELINE),
        shown("middleware_gaps", messages.SUMMARY_GAPS, blocking=_or_empty(shown("blocking_gaps", messages.SUMMARY_BLOCKING))),
        F.when(weeks > 0, fill(messages.SUMMARY_WEEKS, low=fixed(weeks, 0), high=fixed(weeks * F.lit(1.5), 0))),
        F.lit(""),
        F.lit(messages.SUMMARY_READ_ONLY),
        fill(messages.SUMMARY_DATE, date=F.lit(assessed_on)),
    ]
    return joined.select("run_id", F.concat_ws("\n", *lines).alias("executive_summary"))


def executive_summary_penalty(
    scores: DataFrame, summary: DataFrame, scenarios: DataFrame | None = None, assessment: str = "readiness"
) -> DataFrame:
    """Summary text of the penalty scorer.

    ``summary`` comes from ``findings_summary``; ``scenarios`` may give ``target_systems``
    (one text) and ``use_case`` per run; ``assessment`` names the assessment in the text.
    """
    c = F.col
    counts = [
        "schema_inconsistencies", "pipeline_bottlenecks", "middleware_gaps", "data_quality_issues", "critical_issues", "blocking_gaps",
    ]
    joined = scores.join(summary, "run_id", "left").na.fill(0, counts)
    if scenarios is None:
        joined = joined.withColumn("target_systems", F.lit("")).withColumn("use_case", F.lit(None).cast("string"))
    else:
        joined = joined.join(scenarios.select("run_id", "target_systems", "use_case"), "run_id", "left")
    listed = _or_empty(c("target_systems"))
    systems = F.when(listed != "", listed).otherwise(messages.ALL_SYSTEMS)
    total = c("schema_inconsistencies") + c("pipeline_bottlenecks") + c("middleware_gaps")

    def shown(count: Column, template: str) -> Column:
        return F.when(count > 0, fill(template, n=count))

    parts = [
        fill(
            messages.PENALTY_HEAD,
            assessment=F.lit(assessment),
            systems=systems,
            verdict=choose(c("verdict"), messages.VERDICT_PHRASES),
            score=fixed(c("readiness_score"), 0),
        ),
        shown(c("critical_issues"), messages.PENALTY_CRITICAL),
        shown(c("blocking_gaps"), messages.PENALTY_BLOCKING),
        shown(total, messages.PENALTY_TOTAL),
        fill(
            messages.PENALTY_PLAN,
            n=total + c("data_quality_issues"),
            use_case=F.coalesce(c("use_case"), F.lit(messages.PLANNED_DEPLOYMENT)),
        ),
    ]
    return joined.select("run_id", F.concat_ws(" ", *parts).alias("executive_summary"))


def top_issues(findings: DataFrame, gaps: DataFrame, schema_limit: int = 5, gap_limit: int = 3) -> DataFrame:
    """The first findings and gaps of each run, in report order.

    ``findings`` has ``input_ord`` as its order inside a severity, ``gaps`` has ``gap_ord``.
    """
    def first(df: DataFrame, order: list[Column], limit: int, issue_type: str, text: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("run_id").orderBy(*order))
        return (
            df.withColumn("rank", rank)
            .filter(F.col("rank") <= limit)
            .select("run_id", F.lit(issue_type).alias("issue_type"), F.col("rank").cast("long").alias("rank"), "severity", F.col(text).alias("detail"))
        )

    return first(
        findings, [severity_rank(F.col("severity")), F.col("input_ord")], schema_limit, "Schema", "impact_description"
    ).unionByName(first(gaps, [F.col("gap_ord")], gap_limit, "Middleware", "description"))
