"""Summarize the physical plan of every registered query (local check tool).

Writes a Markdown table: shuffles, broadcasts, whole-stage-codegen stages,
columns read and pushed filters of the flagged-table scan.  AQE is switched
off so the static plan is shown (at run time AQE may coalesce or broadcast).
"""
import re
import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from fieldlens import profile as P  # noqa: E402
from fieldlens.plans.engine import run_checks  # noqa: E402
from fieldlens.plans.materialize import RULE_JOB_CONF, session_conf  # noqa: E402
from fieldlens.plans.registry import QUERIES, survey  # noqa: E402
from fieldlens.session import local_session  # noqa: E402

sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
out_path = sys.argv[2] if len(sys.argv) > 2 else None
spark = local_session(8)
spark.conf.set("spark.sql.adaptive.enabled", "false")
spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
lines = ["| query | shuffles | broadcasts | codegen stages | scan columns read | pushed filters |",
         "| --- | --- | --- | --- | --- | --- |"]
for name, fn in QUERIES.items():
    plan = fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    shuffles = len(re.findall(r"Exchange (hashpartitioning|SinglePartition|rangepartitioning|RoundRobin)", plan))
    bcast = plan.count("BroadcastExchange")
    stages = len(set(re.findall(r"\*\((\d+)\)", plan)))
    reads = re.findall(r"ReadSchema: struct<([^\n]*)", plan)
    width = max((r.count(":") for r in reads), default=0)
    pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", plan)
    pushed = "; ".join(sorted({p for p in pushed if p}))[:80] or "-"
    lines.append(f"| {name} | {shuffles} | {bcast} | {stages} | {width} | {pushed} |")
# The rule job itself: the one full-data pass (written once as the flagged table).
with session_conf(spark, RULE_JOB_CONF):
    rule = run_checks(survey(spark, sf_dir), P.fixture())._jdf.queryExecution().executedPlan().toString()
projects = rule.count("Project [")
shuffles = len(re.findall(r"Exchange (hashpartitioning|SinglePartition|rangepartitioning|RoundRobin)", rule))
lines.append("")
lines.append(f"Rule job (`run_checks`, written as the flagged table): {projects} projections, {shuffles} shuffle(s), "
             f"no aggregation, "
             f"no join; Python evaluation nodes: {rule.count('BatchEvalPython') + rule.count('ArrowEvalPython')}.")
text = "\n".join(lines)
if out_path:
    open(out_path, "w").write(text + "\n")
print(text)
