"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from . import hash_tree, rule_ledger

_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def _ledger_sql(policy: str) -> str:
    bits = " + ".join(f"CASE WHEN {r.fails} THEN {r.bit} ELSE 0 END" for r in rule_ledger.RULES)
    w = rule_ledger.WINDOW
    return f"""
WITH base AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
win AS (SELECT rid, i, list_slice(w, i, i + {w - 1}) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - {w - 2})) AS i FROM base WHERE len(w) >= {w})),
hit AS (SELECT rid, i FROM win JOIN (SELECT rid, g FROM win GROUP BY rid, g HAVING count(*) > 1) USING (rid, g)),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + {w})) AS p FROM hit) GROUP BY rid),
lines AS (SELECT rid, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup FROM
  (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM base)),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(n_dup AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(n_lines AS BIGINT) AS n_lines,
  CAST(length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS BIGINT) AS n_upper,
  CAST(length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g')) AS BIGINT) AS n_letters
  FROM base LEFT JOIN cov USING (rid) LEFT JOIN lines USING (rid)),
f AS (SELECT *, CAST({bits} AS BIGINT) AS fail_bits FROM m)
SELECT *, (fail_bits & {rule_ledger.POLICIES[policy]}) = 0 AS kept, (fail_bits & {rule_ledger.BASE_MASK}) <> 0 AS base_failed FROM f"""


def _shard_case(tree: tuple[hash_tree.Leaf, ...]) -> str:
    """The descent as nested SQL over the string key k."""

    def bits(label: str) -> str:
        return f"(CAST(CAST('0x' || substr(md5(k || '/{label}'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / {1 << 52}.0"

    def level(leaves: list, path: str, depth: int) -> str:
        part: dict = {}
        for leaf in leaves:
            part.setdefault(((leaf.region, leaf.rack, leaf.shard)[depth], leaf.layer), []).append(leaf)
        keys = sorted(part)
        labels = [f"{path}{'rks'[depth]}{k[0]}.{k[1]}" for k in keys]
        inner = [str(part[k][0].shard) if depth == 2 else level(part[k], lab, depth + 1) for k, lab in zip(keys, labels, strict=True)]
        if len(keys) == 1:
            return inner[0]
        draws = ", ".join(f"-ln({bits(lab)}) / {float(sum(x.weight for x in part[k]))}" for k, lab in zip(keys, labels, strict=True))
        cases = " ".join(f"WHEN {n + 1} THEN {x}" for n, x in enumerate(inner))
        return f"(CASE list_position([{draws}], list_min([{draws}])) {cases} END)"

    return level(list(tree), "", 0)


def _tree_sql() -> str:
    tree = hash_tree.even_tree(24)
    return f"""
WITH base AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size, text FROM documents),
placed AS (SELECT *, {_shard_case(tree)} AS shard, {_shard_case(hash_tree.grow(tree))} AS grown,
  CAST('0x' || substr(md5(k || '/slot'), 1, 15) AS BIGINT) AS o FROM base)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY o, doc_id, text_crc32, size) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM (SELECT *, {_crc32('text')} AS text_crc32 FROM placed)"""


def _crc32(column: str) -> str:
    """CRC-32 over UTF-8 bytes as a fold over the bytes; the table is made from the polynomial."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    data = f"list_transform(regexp_extract_all(hex(encode(coalesce({column}, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    step = f"xor(c >> 8, list_extract({table}::BIGINT[], CAST(xor(c, d) & 255 AS INTEGER) + 1))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, d: {step}), 4294967295)"


ORACLES = {
    "op3_hash_tree": _tree_sql(),
    "op7_rule_ledger": _ledger_sql("strict-1"),
}
