"""Sessions of agents as events: reading, turns, windows, graders, triggers, availability.

events: session, index (order), kind (prompt, text, tool, result, system), tool, input (JSON text), text, ts, tokens,
sidechain, meta, compact (booleans), origin, and, as read, uuid, parent, tool_id, branch, agent. All graders of a plan run in one aggregation for each session.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.text import matches_any
from docloom.plans.lineage import cut

PATHS = ("file_path", "path", "notebook_path")
#: Kinds of graders: our own (None), and those that users add.
GRADERS: dict = dict.fromkeys(("regex", "tool-usage", "tool-order", "file-access", "skill-invoked", "turn-count", "cost", "json-output"))


def normalize(lines: DataFrame) -> DataFrame:
    """Events of JSON lines (session, pos, value): one for each content block of a message, or for a plain text or another line; a line that isn't JSON is an event of kind "error"."""
    get = lambda v, path, kind="string": F.try_variant_get(v, path, kind)
    v = F.col("v")
    said = lambda x, path: F.when(F.schema_of_variant(get(x, path, "variant")) == "STRING", get(x, path))
    plain = said(v, "$.message.content")
    blocks = get(v, "$.message.content", "array<variant>")
    d = lines.select("session", F.col("pos").alias("at"), "value", F.try_parse_json("value").alias("v"))
    d = d.withColumn("type", get(v, "$.type"))
    one = F.array(F.lit(None).cast("variant"))
    many = F.when(F.schema_of_variant(get(v, "$.message.content", "variant")).startswith("ARRAY"), blocks).otherwise(one)
    d = d.select("*", F.posexplode(many).alias("sub", "block"))
    what = get(F.col("block"), "$.type")
    typed = (F.col("type") == "user") & (what.isNull() | (what == "text"))
    kind = F.when(v.isNull(), "error").when(what == "tool_use", "tool").when(what == "tool_result", "result").when(typed, "prompt").when(F.col("type") == "assistant", "text").otherwise("system")
    text = F.coalesce(said(F.col("block"), "$.text"), said(F.col("block"), "$.content"), plain, said(v, "$.text"))
    tokens = F.coalesce(get(v, "$.message.usage.input_tokens", "long"), F.lit(0)) + F.coalesce(get(v, "$.message.usage.output_tokens", "long"), F.lit(0))
    names = {"uuid": get(v, "$.uuid"), "parent": get(v, "$.parentUuid"), "tool_id": get(F.col("block"), "$.id")}
    flag = lambda path: F.coalesce(get(v, path, "boolean"), F.lit(False))
    w = Window.partitionBy("session").orderBy("at", "sub")
    return d.select(
        "session", (F.row_number().over(w) - 1).cast("long").alias("index"), kind.alias("kind"), get(F.col("block"), "$.name").alias("tool"), F.to_json(get(F.col("block"), "$.input", "variant")).alias("input"), text.alias("text"), F.try_to_timestamp(get(v, "$.timestamp")).alias("ts"),
        F.when(F.col("sub") == 0, tokens).otherwise(0).alias("tokens"), flag("$.isSidechain").alias("sidechain"), flag("$.isMeta").alias("meta"), flag("$.isCompactSummary").alias("compact"), F.coalesce(get(v, "$.origin"), F.lit("human")).alias("origin"),
        *(c.alias(n) for n, c in names.items()),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """Events of all *.jsonl files below a folder; the session is the file's name."""
    d = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.jsonl$", 1)
    return branches(normalize(d.select(name.alias("session"), F.posexplode(F.split("value", "\n")).alias("pos", "value")).where("trim(value) <> ''")))


def branches(events: DataFrame) -> DataFrame:
    """events with branch and agent: the first record of the side chain that an event belongs to, and the agent that was spawned for it; null on the main chain.

    Records lead to their parents; pointers double until each shows its chain's first record, so that a long chain takes a
    few joins. Chains and the calls that spawned them meet by the prompt, equal ones in order of their places.
    """
    up = cut(events.where("sidechain and uuid is not null").select("session", "uuid", "parent").distinct())
    here = up.select("session", F.col("uuid").alias("parent"), F.lit(True).alias("held"))
    up = cut(up.join(here, ["session", "parent"], "left").select("session", "uuid", F.when(F.col("held"), F.col("parent")).otherwise(F.col("uuid")).alias("top")))
    while True:
        far = up.select("session", F.col("uuid").alias("top"), F.col("top").alias("next"))
        up = cut(up.join(far, ["session", "top"]).select("session", "uuid", F.col("next").alias("top"), (F.col("next") != F.col("top")).alias("moved")))
        if up.where("moved").isEmpty():
            break
    nth = F.row_number().over(Window.partitionBy("session", "prompt").orderBy("index"))
    first = events.where("sidechain and kind = 'prompt'").join(up.where("uuid = top").select("session", "uuid"), ["session", "uuid"]).groupBy("session", "uuid").agg(F.min("index").alias("index"), F.min_by("text", "index").alias("prompt"))
    spawn = events.where("kind = 'tool' and tool in ('Task', 'Agent')").select("session", "index", F.get_json_object("input", "$.prompt").alias("prompt"), F.get_json_object("input", "$.subagent_type").alias("agent"))
    told = first.withColumn("nth", nth).join(spawn.withColumn("nth", nth).drop("index"), ["session", "prompt", "nth"], "left").select("session", F.col("uuid").alias("top"), F.coalesce("agent", "uuid").alias("agent"))
    of = up.select("session", "uuid", "top").join(told, ["session", "top"], "left").select("session", "uuid", F.col("top").alias("branch"), F.coalesce("agent", "top").alias("agent"))
    return events.drop("branch", "agent").join(of, ["session", "uuid"], "left").select(*(c for c in events.columns if c not in ("branch", "agent")), "branch", "agent")


def splice(events: DataFrame, more: DataFrame, links: DataFrame) -> DataFrame:
    """events with the events of branch files put in after the calls that spawned them, numbered anew.

    more has a session of its own for each file; links (file, session, tool_id, agent) name the call that each belongs to.
    A file whose call isn't found is put in at the session's end. Spliced events are of a side chain.
    """
    at = events.where("tool_id is not null").groupBy("session", "tool_id").agg(F.min("index").alias("at"))
    end = events.groupBy("session").agg(F.max("index").alias("end"))
    l = links.join(at, ["session", "tool_id"], "left").join(end, "session").select("file", F.col("session").alias("of"), F.coalesce("at", "end").alias("at"), F.col("agent").alias("named"))
    new = {"session": F.col("of"), "sidechain": F.lit(True), "branch": F.col("file"), "agent": F.coalesce("named", "file")}
    b = more.join(l, F.col("session") == F.col("file")).select(*(new.get(c, F.col(c)).alias(c) for c in events.columns), F.col("at").alias("k1"), F.col("file").alias("k2"), F.col("index").alias("k3"))
    d = events.select("*", F.col("index").alias("k1"), F.lit("").alias("k2"), F.lit(-1).cast("long").alias("k3")).unionByName(b)
    n = F.row_number().over(Window.partitionBy("session").orderBy("k1", "k2", "k3")) - 1
    return d.select(*(n.cast("long").alias(c) if c == "index" else F.col(c) for c in events.columns))


def typed_prompt() -> Column:
    """A prompt that a person or a program typed: no meta text, no summary, not in a side chain."""
    return (F.col("kind") == "prompt") & ~F.col("meta") & ~F.col("compact") & ~F.col("sidechain") & F.col("origin").isin("human", "sdk")


def last_turn(events: DataFrame) -> DataFrame:
    """Events from each session's last typed prompt on; none where no work (text or tool) follows."""
    at = events.groupBy("session").agg(F.max(F.when(typed_prompt(), F.col("index"))).alias("at"), F.max(F.when(F.col("kind").isin("text", "tool"), F.col("index"))).alias("work"))
    return events.join(at.where("work > at").select("session", "at"), "session").where(F.col("index") >= F.col("at")).drop("at")


def _injection() -> Column:
    return (F.col("kind") == "tool") & (F.col("tool") == "Skill") | typed_prompt() & F.col("text").rlike(r"^\s*/[A-Za-z]")


def spans(events: DataFrame, skill: str | None = None, command: str | None = None, agent: str | None = None) -> DataFrame:
    """(session, start, end): half-open spans of index that a skill, a slash command or an agent governs; the whole session without any of them.

    A skill begins where its tool is called or its slash form typed, a command where it is typed; both go on to the next
    skill or command on the same chain, or to the session's end. An agent governs the branches that were spawned for it
    (columns branch and agent).
    """
    if agent is not None:
        return events.where(F.col("agent") == agent).groupBy("session", "branch").agg(F.min("index").alias("start"), (F.max("index") + 1).alias("end")).drop("branch")
    if skill is None and command is None:
        return events.groupBy("session").agg(F.min("index").alias("start"), (F.max("index") + 1).alias("end"))
    chain = F.col("branch") if "branch" in events.columns else F.lit(None).cast("string")
    typed = lambda name: typed_prompt() & F.col("text").rlike(rf"^\s*/\Q{name}\E(\s|$)")
    hit = typed(command) if skill is None else typed(skill) | (F.col("tool") == "Skill") & (F.get_json_object("input", "$.skill") == skill)
    end = events.groupBy("session").agg((F.max("index") + 1).alias("last"))
    d = events.where(_injection()).select("session", "index", F.lead("index").over(Window.partitionBy("session", chain).orderBy("index")).alias("next"), F.coalesce(hit, F.lit(False)).alias("hit"))
    return d.where("hit").join(end, "session").select("session", F.col("index").alias("start"), F.coalesce("next", "last").alias("end"))


def within(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Events inside a span: a running count of the spans that are open, not a range join."""
    marks = windows.select("session", F.col("start").alias("index"), F.lit(1).alias("d")).union(windows.select("session", "end", F.lit(-1))).groupBy("session", "index").agg(F.sum("d").alias("d"))
    both = events.join(marks, ["session", "index"], "full").withColumn("open", F.sum(F.coalesce("d", F.lit(0))).over(Window.partitionBy("session").orderBy("index")))
    return both.where("open > 0 and kind is not null").select(*events.columns)


def _file(glob: str) -> Column:
    p = F.coalesce(*(F.get_json_object("input", f"$.{k}") for k in PATHS))
    return F.coalesce((F.col("kind") == "tool") & p.isNotNull() & matches_any(p, [glob]), F.lit(False))


def _calls(g: dict, tool: str, match: str | None) -> Column:
    """Calls of a tool whose input, as JSON, matches a pattern; those of side chains only where the grader includes them."""
    c = (F.col("kind") == "tool") & (F.col("tool") == tool)
    c = c if match is None else c & F.col("input").rlike(match)
    return F.coalesce(c if g.get("includeSidechains") else c & ~F.col("sidechain"), F.lit(False))


def _grader(g: dict) -> tuple[Column, Column]:
    """(outcome, detail) of a grader as aggregates over a session's events.

    A grader with ``when`` (conditions as of triggered()) is skipped in sessions where they don't hold.
    """
    kind = g["kind"]
    if GRADERS.get(kind):
        return GRADERS[kind](g)
    if g.get("when") is not None:
        if kind in ("cost", "json-output"):
            raise ValueError(f"{kind} grades whole sessions and takes no when")
        outcome, detail = _grader({k: v for k, v in g.items() if k != "when"})
        return F.when(_all_of(g["when"]), outcome).otherwise("skipped"), detail
    said = lambda c: F.when(c, "pass").otherwise("fail")
    if kind == "regex":
        hit = F.coalesce(F.bool_or(F.col("kind").isin(g.get("of", ["text"])) & F.col("text").rlike(g["pattern"])), F.lit(False))
        return said(hit if g.get("match", True) else ~hit), hit.cast("string")
    if kind in ("tool-usage", "file-access"):
        touched = lambda: _file(g["glob"]) if g.get("includeSidechains") else _file(g["glob"]) & ~F.col("sidechain")
        n = F.count_if(_calls(g, g["tool"], g.get("inputMatch")) if kind == "tool-usage" else touched())
        if g.get("expect") == "not-used":
            return said(n == 0), n.cast("string")
        return said((n >= g.get("min", 1)) & (n <= g.get("max", 2**31))), n.cast("string")
    if kind == "tool-order":  # of calls that never were, neither is in the wrong order
        at = lambda f, end: f(F.when(_calls(g, g[end], g.get(f"{end}InputMatch")), F.col("index")))
        a, b = at(F.min, "first"), at(F.max, "then")
        return said(F.coalesce(a <= b, a.isNull() & b.isNull())), F.concat_ws("<", a.cast("string"), b.cast("string"))
    if kind == "skill-invoked":
        n = F.count_if(F.coalesce(_injection() & ((F.get_json_object("input", "$.skill") == g["skill"]) | F.col("text").rlike(rf"^\s*/\Q{g['skill']}\E(\s|$)")), F.lit(False)))
        return said(n == 0 if g.get("expect") == "not-used" else n > 0), n.cast("string")
    if kind == "turn-count":
        n = F.count_if(typed_prompt())
        return said((n >= g.get("min", 0)) & (n <= g.get("max", 2**31))), n.cast("string")
    if kind == "cost":
        n = F.sum("tokens")
        return said(n <= g["max"]), n.cast("string")
    if kind == "json-output":
        last = F.max_by(F.when(F.col("kind") == "text", F.col("text")), F.when(F.col("kind") == "text", F.col("index")))
        v = F.try_parse_json(last)
        at = lambda k: "$['" + k.replace("\\", "\\\\").replace("'", "\\'") + "']"
        return said(v.isNotNull() & reduce(Column.__and__, (F.try_variant_get(v, at(k), "variant").isNotNull() for k in g.get("keys", [])), F.lit(True))), F.left(last, F.lit(80))
    raise ValueError(f"unknown grader {kind}")


def grade(events: DataFrame, graders: dict[str, dict]) -> DataFrame:
    """(session, grader, outcome, detail) of named graders; a session without events has no row."""
    rows = F.array(*(F.struct(F.lit(name).alias("grader"), o.alias("outcome"), x.alias("detail")) for name, g in graders.items() for o, x in [_grader(g)]))
    return events.groupBy("session").agg(rows.alias("x")).select("session", F.explode("x").alias("x")).select("session", "x.*")


def grade_by_command(events: DataFrame, name: str, argv: list[str], seconds: int = 60) -> DataFrame:
    """(session, grader, outcome, detail): a program gets a session's events as JSON lines and passes by its exit status."""

    def run(_, g: pd.DataFrame) -> pd.DataFrame:
        lines = g.sort_values("index")[["index", "kind", "tool", "text"]].to_json(orient="records", lines=True)
        try:
            done = subprocess.run(argv, input=lines.encode(), capture_output=True, timeout=seconds, check=False)
            outcome, detail = "pass" if done.returncode == 0 else "fail", done.stdout.decode("utf-8", "replace")[:200]
        except (OSError, subprocess.TimeoutExpired) as x:
            outcome, detail = "error", str(x)
        return pd.DataFrame({"session": g["session"].iloc[:1], "grader": [name], "outcome": [outcome], "detail": [detail]})

    return events.select("session", "index", "kind", "tool", "text").groupBy("session").applyInPandas(run, "session string, grader string, outcome string, detail string")


def _all_of(when: dict) -> Column:
    tests = {
        "file_access": lambda x: F.bool_or(_file(x)),
        "tool_used": lambda x: F.bool_or(F.col("tool") == x),
        "prompt_matches": lambda x: F.bool_or(typed_prompt() & F.col("text").rlike(x)),
        "command_matches": lambda x: F.bool_or((F.col("tool") == "Bash") & F.get_json_object("input", "$.command").rlike(x)),
        "turn_count_above": lambda x: F.count_if(typed_prompt()) > x,
    }
    return reduce(Column.__and__, (F.coalesce(tests[k](x), F.lit(False)) for k, x in when.items()), F.lit(True))


def triggered(events: DataFrame, when: dict) -> DataFrame:
    """(session, triggered): whether all conditions hold in a session: file_access (glob), tool_used, prompt_matches, command_matches (patterns), turn_count_above."""
    return events.groupBy("session").agg(_all_of(when).alias("triggered"))


def availability(changes: DataFrame) -> DataFrame:
    """(session, name, opened, closed) from (session, index, name, change): offered opens an interval unless one is open, withdrawn closes it; closed is null at the end."""
    w = Window.partitionBy("session", "name").orderBy("index")
    d = changes.where(F.col("change").isin("offered", "withdrawn")).withColumn("before", F.lag("change").over(w))
    d = d.where("before is null and change = 'offered' or before <> change")
    return d.withColumn("closed", F.lead("index").over(w)).where("change = 'offered'").select("session", "name", F.col("index").alias("opened"), "closed")


def consensus(votes: DataFrame, by: str, passes: float = 0.8, fails: float = 0.5) -> DataFrame:
    """(by, runs, share, zone) of votes (by, pass): pass, review between the two bounds, or fail."""
    share = F.count_if("pass") / F.count(F.lit(1))
    return votes.groupBy(by).agg(F.count(F.lit(1)).alias("runs"), F.round(share, 6).alias("share"), F.when(share >= passes, "pass").when(share >= fails, "review").otherwise("fail").alias("zone"))


def rescore(runs: DataFrame, by: str, order: str, n: int, passes: float = 0.8, fails: float = 0.5) -> DataFrame:
    """(by, runs, share, zone) by the first n runs of (by, order, pass); insufficient where there are fewer."""
    from docloom.operators.evals import newest

    d = consensus(newest(runs, [by], [F.col(order)], n), by, passes, fails)
    return d.withColumn("zone", F.when(F.col("runs") < n, "insufficient").otherwise(F.col("zone")))


def join_labels(outcomes: DataFrame, labels: DataFrame) -> DataFrame:
    """outcomes (kind, name, actual) with expected and how, of labels (key, expected): by kind:name, else by name alone; ambiguous where several kinds have the name."""
    typed = labels.select(F.col("key").alias("k1"), F.col("expected").alias("e1"))
    plain = labels.select(F.col("key").alias("k2"), F.col("expected").alias("e2"))
    kinds = outcomes.groupBy(F.col("name").alias("n")).agg(F.countDistinct("kind").alias("kinds"))
    j = outcomes.join(typed, F.concat_ws(":", "kind", "name") == F.col("k1"), "left").join(plain, F.col("name") == F.col("k2"), "left").join(kinds, F.col("name") == F.col("n"))
    how = F.when(F.col("e1").isNotNull(), "typed").when(F.col("e2").isNull(), "none").when(F.col("kinds") > 1, "ambiguous").otherwise("name")
    return j.select(*outcomes.columns, F.when(how == "typed", F.col("e1")).when(how == "name", F.col("e2")).alias("expected"), how.alias("how"))


def aggregate(results: DataFrame) -> DataFrame:
    """(level, name, graded, passed, rate, files) of results (artifact, eval, file, outcome, weight): by artifact and by eval, the weighted share of passes over graded ones, 1 if none."""
    graded = F.col("outcome").isin("pass", "fail")
    w, p = F.sum(F.when(graded, F.col("weight"))), F.sum(F.when(F.col("outcome") == "pass", F.col("weight")))
    each = results.select(F.explode(F.array(F.struct(F.lit("artifact").alias("level"), F.col("artifact").alias("name")), F.struct(F.lit("eval").alias("level"), F.col("eval").alias("name")))).alias("x"), "file", "outcome", "weight").select("x.*", "file", "outcome", "weight")
    return each.groupBy("level", "name").agg(F.count_if(graded).alias("graded"), F.count_if(F.col("outcome") == "pass").alias("passed"), F.coalesce(F.round(F.coalesce(p, F.lit(0.0)) / w, 6), F.lit(1.0)).alias("rate"), F.countDistinct("file").alias("files"))


def plan(pages: DataFrame, suites: dict[str, dict]) -> DataFrame:
    """(path, suite, eval, skipped): the evals of each suite whose globs match a page; a page that names an eval in ``skip`` has it marked."""
    rows = [F.when(matches_any(F.col("path"), s["paths"]), F.array(*(F.struct(F.lit(name).alias("suite"), F.lit(e).alias("eval")) for e in s["evals"]))) for name, s in suites.items()]
    d = pages.select("path", "skip", F.explode(F.flatten(F.array_compact(F.array(*rows)))).alias("x"))
    return d.select("path", "x.suite", "x.eval", F.coalesce(F.array_contains("skip", F.col("x.eval")), F.lit(False)).alias("skipped"))


def changed_since(pages: DataFrame, changes: DataFrame, since: int) -> DataFrame:
    """Pages (path, ..) that changes (path, commit) touch after a commit number."""
    return pages.join(changes.where(F.col("commit") > since).select("path").distinct(), "path", "left_semi")


def append_history(results: DataFrame, run: str, path: str) -> None:
    """Adds a run's results to a Parquet history, a folder for each run; a run that exists is refused."""
    results.withColumn("run", F.lit(run)).write.partitionBy("run").mode("append").parquet(path)


def model_judge(cases: DataFrame, judge, by: str = "case") -> DataFrame:
    """(case, pass, reason) by a function of (case, text) pandas frames, which may call a model: the one place where Python decides."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield judge(b)[[by, "pass", "reason"]]

    return cases.select(by, "text").mapInPandas(run, f"{by} string, pass boolean, reason string")
