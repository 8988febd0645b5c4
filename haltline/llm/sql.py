"""DuckDB SQL for the rows of the text queries that SQL can express."""

from __future__ import annotations

#: crc32 of short ASCII texts: the table of one byte's steps, and a macro-like expression over it.
_CRC_TABLE = """
    crc AS (
        SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
            lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
    )"""


def _crc32(value: str) -> str:
    """Unsigned crc32 of a number in decimal; `crc` must be joined."""
    letters = f"list_transform(string_split(({value})::VARCHAR, ''), lambda c: ord(c)::BIGINT)"
    step = "lambda c, b: xor(c >> 8, crc.steps[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {letters}), {step}), 4294967295)"


TOP_PRODUCTS = """
    WITH usable AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id,
               list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
        FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
        WHERE q.vec_id % 100 = 0
    )
    SELECT query_id,
           row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank,
           vec_id, score
    FROM scored
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""


def _leaf(text: str) -> str:
    fields = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
    return "sha256({})".format(
        " || ".join(f"coalesce(strlen({field})::VARCHAR || ':' || {field}, '-')" for field in fields)
    )


def _levels(name: str, count: int) -> list[str]:
    """Tables name1 … over name0(tree, rank, digest); a tree of one node stays as it is."""
    return [
        f"""{name}{k + 1} AS (
            SELECT tree, rank // 16 AS rank,
                   CASE WHEN max(n) = 1 THEN max(digest) ELSE sha256(string_agg(digest, '' ORDER BY rank)) END
                       AS digest
            FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}{k})
            GROUP BY tree, rank // 16)"""
        for k in range(count)
    ]


def _folds(rows: str, name: str, count: int, tree: str, rank: str) -> list[str]:
    """Tables {rows}_{name}1 …: `proof` with the siblings of one more level, `folded` one level higher."""
    steps = []
    for k in range(count):
        before = rows if k == 0 else f"{rows}_{name}{k}"
        steps.append(
            f"""{rows}_{name}{k + 1} AS (
            SELECT r.* EXCLUDE (proof, folded),
                   r.proof || coalesce(array_to_string(s.left_part, ''), '')
                           || coalesce(array_to_string(s.right_part, ''), '') AS proof,
                   CASE WHEN s.alone THEN r.folded
                        ELSE sha256(coalesce(array_to_string(s.left_part, ''), '') || r.folded
                                    || coalesce(array_to_string(s.right_part, ''), '')) END AS folded
            FROM {before} r JOIN (
                SELECT tree, rank,
                       list(digest) OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS left_part,
                       list(digest) OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS right_part,
                       count(*) OVER (PARTITION BY tree) = 1 AS alone
                FROM {name}{k} WINDOW run AS (PARTITION BY tree, rank // 16 ORDER BY rank)
            ) s ON s.tree = r.{tree} AND s.rank = r.{rank} // {16**k})"""
        )
    return steps


#: Sources of up to 16 ** 6 rows, up to 16 ** 4 sources: beyond the tables this is compared on.
MERKLE_ROWS = "WITH " + ",\n".join(
    [
        _CRC_TABLE,
        f"""rows0 AS (
            SELECT d.doc_id, coalesce('s' || source, '') AS tree, {_leaf("text")} AS leaf,
                   CASE WHEN {_crc32("d.doc_id")} % 5 = 0
                        THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
                   END AS tampered
            FROM documents d, crc)""",
        """ranked AS (
            SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank
            FROM rows0)""",
        "n0 AS (SELECT tree, rank, leaf AS digest FROM ranked)",
        *_levels("n", 6),
        "t0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS rank, tree AS source, digest FROM n6)",
        *_levels("t", 4),
        """r AS (
            SELECT k.*, '' AS top, t0.rank AS place, t0.digest AS subroot, t4.digest AS root, '' AS proof,
                   coalesce(tampered, leaf) AS folded
            FROM ranked k JOIN t0 ON t0.source = k.tree, t4)""",
        *_folds("r", "n", 6, "tree", "rank"),
        "q AS (SELECT * FROM r_n6)",
        *_folds("q", "t", 4, "top", "place"),
    ]
) + """
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root,
           folded = root AS verified
    FROM q_t4
"""

PERIODIC_RUNS = rf"""
    WITH {_CRC_TABLE}, split AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
               {_crc32("doc_id")} AS h
        FROM documents, crc
    ), placed AS (
        SELECT *, len(words) AS n, (h // 10) % len(words) AS a, 3 + (h // 10) % 8 AS power FROM split
    ), looped AS (
        SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
            THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN words[i + 1]
                     ELSE words[a + (i - a) % (1 + (n - a) // power) + 1] END)
            ELSE words END AS words
        FROM placed
    ), word AS (
        SELECT doc_id, n, unnest(range(n)) AS i, unnest(words) AS w FROM looped
    ), same AS (
        SELECT l.doc_id, l.i, r.i - l.i AS q
        FROM word l JOIN word r ON l.doc_id = r.doc_id AND l.w = r.w AND r.i > l.i AND r.i <= l.i + l.n // 4
    ), islands AS (
        SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same
    ), stretches AS (
        SELECT doc_id, min(i) AS start, count(*) + q AS length, q AS period
        FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)
    ), runs AS (  -- a stretch also has the multiples of its smallest period
        SELECT doc_id, start, length, min(period) AS period FROM stretches GROUP BY doc_id, start, length
    ), kept AS (
        SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS rest FROM word
        WHERE NOT EXISTS (FROM runs r WHERE r.doc_id = word.doc_id
                          AND word.i >= r.start + r.period AND word.i < r.start + r.length)
        GROUP BY doc_id
    ), best AS (
        SELECT * FROM runs QUALIFY row_number() OVER (
            PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1
    ), listed AS (
        SELECT doc_id, count(*) AS n_runs,
               string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
        FROM runs GROUP BY doc_id
    )
    SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period,
           1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
           sha256(coalesce(rest, '')) AS collapsed_sha256, n AS n_words
    FROM looped d LEFT JOIN best USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _guarded(text: str, *marks: str) -> str:
    """`text` with a backslash before every backslash and mark."""
    found = rf"replace({text}, '\', '\\')"
    for mark in marks:
        found = rf"replace({found}, '{mark}', '\{mark}')"
    return found


_TRICKY = r"\### Assistant: </turn> ok"

CHAT_DIGESTS = rf"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '{_TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{_TRICKY}'
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role))
               AS turns_sha256,
           sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
           sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, ''
                             ORDER BY turn NULLS FIRST, role)) AS loss_sha256,
           sum(length('### : ') + length(' </turn> ')
               + length({_guarded("role", "### ", "</turn>", ":")})
               + length({_guarded("text", "### ", "</turn>")}))::BIGINT AS formatted_chars
    FROM turns GROUP BY conv_id
"""
