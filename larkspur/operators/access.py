"""Access control over relations: groups, memberships, path rules, sessions, and their replication.

Tables: groups (name, rights), memberships (user, grp), paths (path_id, prefix, grp, is_public,
rights), sessions (session, user, expires). Rights are 64 bits in a signed long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import validate as V

KEY_CHARS = 512
RECORD_TYPES = ("user", "group", "membership", "path")


def group_rights(memberships: DataFrame, groups: DataFrame) -> DataFrame:
    """(user, rights): all of a user's groups' rights together; groups that don't exist add nothing."""
    held = memberships.join(groups.withColumnRenamed("name", "grp"), "grp")
    return held.groupBy("user").agg(F.bit_or("rights").alias("rights"))


def longest_prefix(requests: DataFrame, paths: DataFrame, key: str = "path") -> DataFrame:
    """Requests with their rule's columns (null without one): the longest prefix, of equals the first path_id.

    A theta join on prefixes would compare every request with every rule. Rules have at most 512
    lengths: a request is exploded into its prefixes of those lengths, and the join is on equality.
    """
    lengths = [r[0] for r in paths.select(F.length("prefix")).distinct().collect()]  # at most KEY_CHARS values
    rule = paths.select(*[F.col(c).alias(f"rule_{c}") for c in paths.columns])
    if not lengths:
        return requests.select("*", *[F.lit(None).cast(t).alias(c) for c, t in rule.dtypes])
    # one rule for each prefix: the first by id; then a request meets at most one rule a length
    first = Window.partitionBy("rule_prefix").orderBy("rule_path_id")
    rule = rule.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
    starts = F.array(*[F.when(F.length(key) >= n, F.left(F.col(key), F.lit(n))) for n in sorted(lengths)])
    asked = requests.select(key).distinct()
    met = asked.select(key, F.explode(F.array_compact(starts)).alias("rule_prefix")).join(rule, "rule_prefix")
    best = met.groupBy(key).agg(F.max_by(F.struct(*rule.columns), F.length("rule_prefix")).alias("best"))
    return requests.join(best, key, "left").select(*requests.columns, "best.*")


def check(cases: DataFrame, sessions: DataFrame, memberships: DataFrame, groups: DataFrame, paths: DataFrame, now: int) -> DataFrame:
    """Adds allowed, reason and effective to cases (case_id, session, path, wanted, public_scope).

    In order: invalid_path and no_session are errors (allowed null), then no_path_rule,
    path_not_public, group_mismatch, and last allow or deny by the effective rights.
    """
    live = sessions.filter(F.col("expires") >= now).select("session", "user")
    rows = longest_prefix(cases.join(live, "session", "left"), paths)
    rows = rows.join(group_rights(memberships, groups).withColumnRenamed("rights", "own"), "user", "left")
    member = memberships.select(F.col("user"), F.col("grp").alias("rule_grp"), F.lit(True).alias("is_member")).distinct()
    rows = rows.join(member, ["user", "rule_grp"], "left")
    reason = (
        F.when(~V.path_valid(F.col("path")), "invalid_path")
        .when(F.col("user").isNull(), "no_session")
        .when(F.col("rule_path_id").isNull(), "no_path_rule")
        .when(F.col("public_scope") & ~F.col("rule_is_public"), "path_not_public")
        .when(F.col("rule_grp").isNotNull() & F.col("is_member").isNull(), "group_mismatch")
    )
    effective = F.when(reason.isNull(), F.coalesce("own", F.lit(0)).bitwiseAND(F.col("rule_rights"))).otherwise(F.lit(0)).cast("long")
    rows = rows.select("case_id", "wanted", reason.alias("no"), effective.alias("effective"))
    grants = F.col("effective").bitwiseAND(F.col("wanted")) == F.col("wanted")
    return rows.select(
        "case_id",
        F.when(F.col("no").isin("invalid_path", "no_session"), F.lit(None)).otherwise(F.col("no").isNull() & grants).cast("boolean").alias("allowed"),
        F.coalesce("no", F.when(grants, "allow").otherwise("deny")).alias("reason"),
        "effective",
    )


def replay(events: DataFrame) -> DataFrame:
    """(record_type, key, value_json) after all events: the last of each key by arrival wins, whatever its version.

    Events with a blank key, one over 512 bytes, or an upsert without a value are errors, and change nothing.
    """
    good = events.filter((F.trim("key") != "") & (F.octet_length("key") <= KEY_CHARS) & ((F.col("op") == "delete") | F.col("value_json").isNotNull()))
    last = good.groupBy("record_type", "key").agg(F.max_by(F.struct("op", "value_json"), "seq").alias("last"))
    return last.filter("last.op = 'upsert'").select("record_type", "key", F.col("last.value_json").alias("value_json"))


def export(**tables: DataFrame) -> DataFrame:
    """(record_type, key, value_json): every record as an upsert. Keyword: record type = table with a ``key`` column."""
    out = None
    for kind, table in tables.items():
        body = F.to_json(F.struct(*[c for c in table.columns if c != "key"]), {"ignoreNullFields": "false"})
        rows = table.select(F.lit(kind).alias("record_type"), F.col("key"), body.alias("value_json"))
        out = rows if out is None else out.unionByName(rows)
    return out


def any_user(users: DataFrame) -> bool:
    """Whether there is a user at all; reads one row."""
    return not users.isEmpty()


def verdicts(new: DataFrame, key: str, valid: Column, known: DataFrame, needs: tuple[DataFrame, str] | None = None) -> DataFrame:
    """Adds ``error`` to new records: invalid_input, not_found (what it needs), already_exists, in that order, or null.

    Of new records with one key the first by the rest of the row is added, the others exist already.
    """
    held = known.select(F.col(key).alias("_key")).distinct().withColumn("_held", F.lit(True))
    rows = new.join(held, F.col(key) == F.col("_key"), "left")
    missing = F.lit(False)
    if needs:
        there, ref = needs
        rows = rows.join(there.select(F.col(there.columns[0]).alias("_ref")).distinct().withColumn("_there", F.lit(True)), F.col(ref) == F.col("_ref"), "left")
        missing = F.col(ref).isNotNull() & F.col("_there").isNull()
    error = F.when(~F.coalesce(valid, F.lit(False)), "invalid_input").when(missing, "not_found").when(F.col("_held").isNotNull(), "already_exists")
    rows = rows.select(*new.columns, error.alias("error"))
    nth = F.row_number().over(Window.partitionBy(key, F.col("error").isNull()).orderBy(*[c for c in new.columns if c != key]))
    return rows.withColumn("error", F.when(F.col("error").isNull() & (nth > 1), "already_exists").otherwise(F.col("error")))


def _added(known: DataFrame, judged: DataFrame) -> DataFrame:
    return known.unionByName(judged.filter("error is null").select(*known.columns))


def group_verdicts(groups: DataFrame, new: DataFrame) -> DataFrame:
    return verdicts(new, "name", V.name_valid(F.col("name")), groups)


def add_group(groups: DataFrame, new: DataFrame) -> DataFrame:
    """Groups with the new ones (name, rights) that are valid and don't exist yet."""
    return _added(groups, group_verdicts(groups, new))


def user_verdicts(users: DataFrame, new: DataFrame, groups: DataFrame) -> DataFrame:
    """New users (user, grp, pw_hash): both names valid, the group there, the user not; hashes are made elsewhere and opaque."""
    return verdicts(new, "user", V.name_valid(F.col("user")) & V.name_valid(F.col("grp")), users, (groups.select("name"), "grp"))


def add_user(users: DataFrame, memberships: DataFrame, new: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users (user, locked, pw_hash) and memberships with the new users, each in its group."""
    good = user_verdicts(users, new, groups).filter("error is null")
    joined = good.select("user", "grp").join(memberships, ["user", "grp"], "left_anti")
    return users.unionByName(good.select("user", F.lit(False).alias("locked"), "pw_hash").select(*users.columns)), memberships.unionByName(joined.select(*memberships.columns))


def add_membership(memberships: DataFrame, new: DataFrame, groups: DataFrame, users: DataFrame) -> DataFrame:
    """Memberships with the new ones (user, grp) whose user and group exist, once each."""
    known = new.join(users.select("user"), "user", "left_semi").join(groups.select(F.col("name").alias("grp")), "grp", "left_semi").select("user", "grp")
    return memberships.unionByName(known.distinct().join(memberships, ["user", "grp"], "left_anti"))


def path_verdicts(paths: DataFrame, new: DataFrame, groups: DataFrame) -> DataFrame:
    return verdicts(new, "path_id", V.path_valid(F.col("prefix")) & (F.col("grp").isNull() | V.name_valid(F.col("grp"))), paths, (groups.select("name"), "grp"))


def add_path(paths: DataFrame, new: DataFrame, groups: DataFrame) -> DataFrame:
    """Rules with the new ones whose prefix is valid and whose group, if any, exists."""
    return _added(paths, path_verdicts(paths, new, groups))


# What a collection without users starts with.
FIRST_GROUP, FIRST_PREFIX, FIRST_RIGHTS = "admins", "Documents", ("read", "write", "create")


def bootstrap(users: DataFrame, memberships: DataFrame, groups: DataFrame, paths: DataFrame, user: str, pw_hash: str, path_id: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(users, memberships, groups, paths) with a first administrator, a group with all rights and a rule; unchanged where there is any user."""
    if any_user(users):
        return users, memberships, groups, paths
    spark = users.sparkSession
    every = sum(V.RIGHTS.values())
    some = sum(V.RIGHTS[r] for r in FIRST_RIGHTS)
    groups = add_group(groups, spark.createDataFrame([(FIRST_GROUP, every)], "name string, rights long"))
    first = spark.createDataFrame([(user, FIRST_GROUP, pw_hash)], "user string, grp string, pw_hash string")
    users, memberships = add_user(users, memberships, first, groups)
    rule = spark.createDataFrame([(path_id, FIRST_PREFIX, FIRST_GROUP, False, some)], "path_id string, prefix string, grp string, is_public boolean, rights long")
    return users, memberships, groups, add_path(paths, rule, groups)


def audit(actions: DataFrame, actor: str, action: str, key: str, now: int) -> DataFrame:
    """(ts, actor, action, target, detail): a record for each judged row (``verdicts``) that was accepted, to be appended."""
    good = actions.filter("error is null")
    return good.select(F.lit(now).cast("long").alias("ts"), F.lit(actor).alias("actor"), F.lit(action).alias("action"), F.col(key).alias("target"), F.lit("ok").alias("detail"))


def login_proof(pw_hash: str, nonce: str, challenge: str, node: str) -> Column:
    """SHA-256 over the hashed password hash, nonce, challenge id and node id (column names; nonce is binary)."""
    return F.sha2(F.concat(F.unhex(F.sha2(F.col(pw_hash), 256)), F.col(nonce), F.encode(F.col(challenge), "UTF-8"), F.encode(F.col(node), "UTF-8")), 256)


def live(rows: DataFrame, now: int) -> DataFrame:
    """Rows that haven't expired: expired only once now is later than ``expires``."""
    return rows.filter(F.col("expires") >= now)
