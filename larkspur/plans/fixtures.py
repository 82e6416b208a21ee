"""Small relations that queries and their SQL share: VALUES text that both engines read alike."""

ADMIN = "CAST('-9223372036854775808' AS BIGINT)"

GROUPS = f"SELECT * FROM (VALUES ('readers', CAST(1 AS BIGINT)), ('writers', CAST(7 AS BIGINT)), ('admins', {ADMIN}), ('nobody', CAST(0 AS BIGINT))) AS t(name, rights)"
MEMBERSHIPS = "SELECT * FROM (VALUES ('ann', 'readers'), ('ann', 'writers'), ('bob', 'readers'), ('cyd', 'admins'), ('dan', 'gone'), ('eve', 'nobody')) AS t(\"user\", grp)"
PATHS = f"""SELECT * FROM (VALUES
 ('p1', 'http', CAST(NULL AS VARCHAR(20)), true, CAST(3 AS BIGINT)), ('p2', 'https://', 'readers', true, CAST(1 AS BIGINT)), ('p3', 'https://', 'writers', false, CAST(7 AS BIGINT)),
 ('p4', 'https://blog', 'writers', false, CAST(15 AS BIGINT)), ('p5', 'http://th', CAST(NULL AS VARCHAR(20)), false, {ADMIN}), ('p6', 'https://m.', 'admins', true, {ADMIN})
) AS t(path_id, prefix, grp, is_public, rights)"""
SESSIONS = "SELECT * FROM (VALUES ('s-ann', 'ann', CAST(2000 AS BIGINT)), ('s-bob', 'bob', CAST(1000 AS BIGINT)), ('s-old', 'bob', CAST(999 AS BIGINT)), ('s-cyd', 'cyd', CAST(1500 AS BIGINT)), ('s-dan', 'dan', CAST(1500 AS BIGINT))) AS t(session, \"user\", expires)"
NOW = 1000
WANTED = [("read", 1, True), ("write", 2, False), ("none", 0, True)]
EVENTS = """SELECT * FROM (VALUES
 (CAST(1 AS BIGINT), 'user', 'upsert', 'ann', '{"version":2}'), (CAST(2 AS BIGINT), 'user', 'upsert', 'ann', '{"version":1}'), (CAST(3 AS BIGINT), 'group', 'upsert', 'g', '{"rights":1}'),
 (CAST(4 AS BIGINT), 'group', 'delete', 'g', CAST(NULL AS VARCHAR(20))), (CAST(5 AS BIGINT), 'path', 'upsert', 'p', '{"p":1}'), (CAST(6 AS BIGINT), 'path', 'upsert', 'p', CAST(NULL AS VARCHAR(20))),
 (CAST(7 AS BIGINT), 'membership', 'upsert', ' ', '{"m":1}'), (CAST(8 AS BIGINT), 'membership', 'upsert', 'ann::g', '{"m":2}'), (CAST(9 AS BIGINT), 'user', 'delete', 'never', CAST(NULL AS VARCHAR(20)))
) AS t(seq, record_type, op, key, value_json)"""
LOGINS = "SELECT * FROM (VALUES ('hash-a', '00ff10ab', 'c1', 'node-1'), ('', '', 'c2', 'node-1'), ('hash-b', 'deadbeef', '', '')) AS t(pw_hash, nonce_hex, challenge, node)"
RIGHTS_TEXT = "SELECT * FROM (VALUES ('read'), (' Write '), ('CREATE'), ('publish'), ('local'), ('public'), ('admin'), ('0xff'), ('0x8000000000000000'), ('17'), ('18446744073709551615'), ('18446744073709551616'), ('-1'), ('none'), (''), ('0xfffffffffffffffff')) AS t(s)"


def spark(sql: str) -> str:
    """The same text for Spark, whose quoted names are in backticks and whose strings have no length."""
    return sql.replace('"user"', "`user`").replace("VARCHAR(20)", "STRING")
