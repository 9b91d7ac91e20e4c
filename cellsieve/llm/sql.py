"""The same results in SQL, for the queries that SQL can express."""

from __future__ import annotations

from cellsieve.llm import chat_format, hash_tree, mixing
from cellsieve.llm.decontaminate import CAPITALS, SMALL, WINDOW

WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"


def lowered(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{CAPITALS}', '{SMALL}')"


# --- op4 -----------------------------------------------------------------------------------

CRC_TABLE = """
SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab"""


def _draw(path: str, weight: float) -> str:
    bits = f"('0x' || substr(md5(key || '/{path}'), 1, 13))::BIGINT::DOUBLE"
    return f"struct_pack(draw := -ln(({bits} + 0.5) / {1 << 52}) / {weight:.1f}, path := '{path}')"


def _descent(tree: hash_tree.ShardTree) -> str:
    """Nested CASEs over the children of every node."""
    below = hash_tree._children(tree)

    def at(path: str) -> str:
        children = below.get(path)
        if children is None:
            return path.rpartition("/")[2]
        least = f"list_min([{', '.join(_draw(p, w) for p, w in children)}]).path"
        if len(children) == 1:
            return at(children[0][0])
        return f"CASE {least} {' '.join(f'''WHEN '{p}' THEN {at(p)}''' for p, _ in children)} END"

    return at("")


def op4(tree: hash_tree.ShardTree, grown: hash_tree.ShardTree) -> str:
    return rf"""
WITH crc AS ({CRC_TABLE}), d AS (
    SELECT doc_id, coalesce(text, '') AS text, 's0/' || coalesce(doc_id::VARCHAR, 'null') AS key FROM documents
), b AS (
    SELECT doc_id, key, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM d
), c AS (
    SELECT doc_id, key, len(bytes) + 1 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes),
        lambda a, x: xor(a >> 8, tab[1 + (xor(a, x) & 255)])), 4294967295) AS text_crc32 FROM b, crc
), s AS (
    SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law,
        ({_descent(tree)})::INT AS shard, ({_descent(grown)})::INT AS grown_shard FROM c
)
SELECT doc_id, size, text_crc32, law, shard, row_number() OVER (PARTITION BY shard ORDER BY
    substr(md5(coalesce(doc_id::VARCHAR, 'null') || '/' || text_crc32 || '/' || size), 1, {hash_tree.CELL_DIGITS}),
    doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM s"""


# --- op5 -----------------------------------------------------------------------------------

OP5 = rf"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lowered('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), i AS (
    SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all({lowered('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), n AS (
    SELECT item, w, least(len(w), {WINDOW}) AS size FROM i WHERE len(w) > 0
), p AS (
    SELECT item, w, size, unnest(range(len(w) - size + 1)) AS k FROM n
), wi AS (
    SELECT DISTINCT item, size, array_to_string(w[k + 1:k + size], ' ') AS words FROM p
), q AS (
    SELECT r, w, size, unnest(range(greatest(len(w) - size + 1, 0))) AS k FROM d, (SELECT DISTINCT size FROM n)
), h AS (
    SELECT r, k, q.size, item FROM q JOIN wi ON wi.size = q.size AND wi.words = array_to_string(q.w[k + 1:k + q.size], ' ')
), places AS (
    SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS place FROM h) GROUP BY r
), found AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM h) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN found USING (r)"""


# --- op7 -----------------------------------------------------------------------------------

def op7(size: int, percent: int) -> str:
    """All pairs that share a shingle. Every document is its own row, so equal ids are told apart."""
    return rf"""
WITH RECURSIVE d AS (
    SELECT row_number() OVER () AS r, doc_id, {WORDS.format(text=lowered('text'))} AS w FROM documents
), s AS (
    SELECT DISTINCT r, array_to_string(w[k + 1:k + {size}], ' ') AS x
    FROM (SELECT r, w, unnest(range(greatest(len(w) - {size - 1}, 1))) AS k FROM d WHERE len(w) > 0)
), n AS (SELECT r, count(*) AS n FROM s GROUP BY r
), pairs AS (
    SELECT a.r AS a, b.r AS b, count(*) AS common FROM s a JOIN s b ON a.x = b.x AND a.r < b.r GROUP BY ALL
), links AS (
    SELECT a, b FROM pairs JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * common >= {percent} * (na.n + nb.n - common)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (SELECT DISTINCT a, a AS b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a
), least AS (SELECT a AS r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, CASE WHEN l.r IS NULL THEN doc_id ELSE component_id END AS component_id,
    doc_id IS NOT DISTINCT FROM CASE WHEN l.r IS NULL THEN doc_id ELSE component_id END AS kept
FROM d LEFT JOIN n USING (r) LEFT JOIN least l USING (r)"""


# --- op9 -----------------------------------------------------------------------------------

def op9(control: str) -> str:
    turn = len(chat_format.HEAD) + len(chat_format.AFTER_ROLE) + len(chat_format.END)
    count = "(len({0}) - len(replace({0}, {1}, ''))) / len({1})"
    escapes = " + ".join([
        count.format("text", r"'\'"), count.format("text", "'</turn>'"),
        "coalesce(list_sum(list_transform(regexp_extract_all(text, '###+'), lambda x: len(x) - 2)), 0)",
        count.format("role", r"'\'"), count.format("role", "chr(10)")])
    order = "turn NULLS FIRST, given_role NULLS FIRST, given_text NULLS FIRST"
    return rf"""
WITH t AS (
    SELECT conv_id, turn, role AS given_role, text AS given_text, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
        SELECT conv_id, turn, role, text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '{control}' UNION ALL SELECT -7, 1, 'assistant', '{control}')
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY {order})) AS turns_sha256,
    coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY {order}) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum({turn} + len(role) + len(text) + {escapes})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""


# --- op10 ----------------------------------------------------------------------------------

def op10() -> str:
    block, most, share = mixing.BLOCK_WORDS, mixing.MOST, mixing.SHARE
    weight = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mixing.WEIGHTS))
    return rf"""
WITH d AS (
    SELECT doc_id, source, len({WORDS.format(text='text')})::BIGINT AS size,
        md5('{mixing.SEED}/' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents
), p AS (
    SELECT *, ('0x' || key[1])::INT AS shard, sum(size) OVER (PARTITION BY source ORDER BY key, size
        ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM d
), s AS (
    SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM d GROUP BY source
), w AS (
    SELECT *, (CASE (nth - 1) % {len(mixing.WEIGHTS)} {weight} END)::DOUBLE AS w FROM s
), ordered AS (  -- sources are cut in the order of size by weight
    SELECT *, row_number() OVER o AS k, sum({most} * s) OVER o - {most} * s AS cut_sum, sum(w) OVER () - (sum(w) OVER o - w) AS w_rest,
        sum(s) OVER () AS total FROM w WINDOW o AS (ORDER BY s / w, nth ROWS UNBOUNDED PRECEDING)
), level AS (
    SELECT *, {share} * total - cut_sum AS rest, w * ({share} * total - cut_sum) / w_rest <= {most} * s AS fits FROM ordered
), first_fit AS (
    SELECT k AS k0, rest AS r0, w_rest AS w0 FROM level WHERE fits ORDER BY k LIMIT 1
), t AS (
    SELECT source, s, nth, total, CASE WHEN k0 IS NULL OR k < k0 THEN ({most} * s)::DOUBLE ELSE (w * r0 / w0)::DOUBLE END AS target
    FROM ordered LEFT JOIN first_fit ON true
), quotients AS (
    SELECT source, nth, target / (2 * unnest(range(({most} * ((s + {block - 1}) // {block}))::BIGINT)) + 1) AS q, total FROM t WHERE target > 0
), seats AS (
    SELECT source, count(*) AS blocks FROM (
        SELECT source, row_number() OVER (ORDER BY q DESC, nth) AS place, floor({share} * total / {block} + 0.5) AS seats FROM quotients)
    WHERE place <= seats GROUP BY source
), sh AS (
    SELECT source, shard, sum(words) OVER (PARTITION BY source ORDER BY shard)::BIGINT - words AS a, words FROM (
        SELECT sources.source, shard, coalesce(words, 0)::BIGINT AS words
        FROM (SELECT source, unnest(range({mixing.SHARDS})) AS shard FROM s) sources
        LEFT JOIN (SELECT source, shard, sum(size) AS words FROM p GROUP BY ALL) x USING (shard)
        WHERE x.source IS NOT DISTINCT FROM sources.source OR x.source IS NULL AND words IS NULL)
), counts AS (
    SELECT source, shard, (a + {block - 1}) // {block} AS first, (a + words + {block - 1}) // {block} - (a + {block - 1}) // {block} AS n FROM sh
), shard_quotients AS (
    SELECT source, shard, n::DOUBLE / (2 * unnest(range({most} * n)) + 1) AS q FROM counts
), quotas AS (
    SELECT source, shard, count(*) AS quota FROM (
        SELECT x.source, shard, row_number() OVER (PARTITION BY x.source ORDER BY q DESC, shard) AS place, blocks
        FROM shard_quotients x JOIN seats ON seats.source IS NOT DISTINCT FROM x.source)
    WHERE place <= blocks GROUP BY ALL
), plan AS (
    SELECT c.source, c.shard, first, n, quota // n AS every, quota % n AS more,
        ('0x' || substr(md5('{mixing.SEED}/' || coalesce('s' || c.source, 'null') || '/' || c.shard), 1, 12))::BIGINT % n AS start
    FROM counts c JOIN quotas q ON q.source IS NOT DISTINCT FROM c.source AND q.shard = c.shard WHERE n > 0
), runs AS (
    SELECT source, first AS lo, first + n AS hi, every AS times FROM plan
    UNION ALL SELECT source, first + start, first + least(start + more, n), 1 FROM plan
    UNION ALL SELECT source, first, first + start + more - n, 1 FROM plan WHERE start + more > n
), overlap AS (
    SELECT p.source, p.key, p.size, p.upto, sum(times * greatest(0, least(hi * {block}, upto) - greatest(lo * {block}, upto - size))) AS taken
    FROM p LEFT JOIN runs ON runs.source IS NOT DISTINCT FROM p.source GROUP BY ALL
)
SELECT doc_id, p.size, t.s AS source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM p JOIN t ON t.source IS NOT DISTINCT FROM p.source
JOIN overlap o ON o.source IS NOT DISTINCT FROM p.source AND o.key = p.key AND o.size = p.size AND o.upto = p.upto"""


# --- op11 ----------------------------------------------------------------------------------

def _leaf(text: str) -> str:
    fields = [f"{c}::VARCHAR" for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


def _climb(name: str, start: str, levels: str, same: str) -> str:
    """From the rows of ``start`` up the lists of hashes in ``levels``."""
    run = "8 * (c.pos // 8)"
    left = f"array_to_string(h[{run} + 1:c.pos], '')"
    right = f"array_to_string(h[c.pos + 2:{run} + 8], '')"
    return f"""{name} AS (
    SELECT * FROM ({start})
    UNION ALL SELECT c.r, c.lang, c.level + 1, c.pos // 8, sha256({left} || c.folded || {right}), c.siblings || {left} || {right}
    FROM {name} c JOIN {levels} t ON t.level = c.level{same} WHERE len(h) > 1)"""


def op11() -> str:
    above = "list_transform(range((len(h) + 7) // 8), lambda i: sha256(array_to_string(h[8 * i + 1:8 * i + 8], '')))"
    return rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}), b AS (
    SELECT *, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes
    FROM documents
), d AS (
    SELECT row_number() OVER () AS r, doc_id, lang, {_leaf('text')} AS leaf, CASE WHEN xor(list_reduce(
        list_prepend(4294967295::BIGINT, bytes), lambda a, x: xor(a >> 8, tab[1 + (xor(a, x) & 255)])), 4294967295) % 3 = 0
        THEN {_leaf(f"translate(text, '{CAPITALS}', '{SMALL}')")} ELSE {_leaf('text')} END AS claim FROM b, crc
), p AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos FROM d
), trees AS (
    SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS h FROM p GROUP BY lang
    UNION ALL SELECT lang, level + 1, {above} FROM trees WHERE len(h) > 1
), subs AS (
    SELECT lang, h[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS nth FROM trees WHERE len(h) = 1
), tops AS (
    SELECT 0 AS level, list(subroot ORDER BY nth) AS h FROM subs
    UNION ALL SELECT level + 1, {above} FROM tops WHERE len(h) > 1
), {_climb('low', "SELECT r, lang, 0 AS level, pos, claim AS folded, '' AS siblings FROM p", 'trees',
           ' AND t.lang IS NOT DISTINCT FROM c.lang')
}, subfolds AS (
    SELECT DISTINCT ON (r) r, lang, folded, siblings FROM low ORDER BY r, level DESC
), {_climb('high', 'SELECT r, s.lang, 0 AS level, nth AS pos, folded, siblings FROM subfolds f JOIN subs s '
           'ON s.lang IS NOT DISTINCT FROM f.lang', 'tops', '')
}, ends AS (
    SELECT DISTINCT ON (r) r, folded, siblings FROM high ORDER BY r, level DESC
)
SELECT doc_id, leaf, subroot, h[1] AS root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = h[1] AS verified
FROM p JOIN ends USING (r) JOIN subs ON subs.lang IS NOT DISTINCT FROM p.lang JOIN tops ON len(h) = 1"""
