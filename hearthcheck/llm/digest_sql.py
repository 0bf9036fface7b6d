"""SQL of the two operators whose definition is a long chain of integer steps: hard negatives and the Merkle manifest."""

from __future__ import annotations

LEVELS = 7  # 16^7 leaves in a source


def crc32(text: str) -> str:
    """crc32 of an ASCII text, bit by bit: the reversed polynomial 0xEDB88320."""
    step = "CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: {step})"
    codes = f"list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {byte}), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, rows: str) -> list[str]:
    """CTEs of one set of trees: rows (tree, idx, hash, n) joined level by level; name_top (tree, hash), name_up (tree, idx, lefts, rights)."""
    ctes = [f"{name}0 AS ({rows})"]
    for k in range(LEVELS):
        ctes.append(
            f"{name}_run{k} AS (SELECT tree, idx // 16 AS run, any_value(n) AS n, list(hash ORDER BY idx) AS hashes FROM {name}{k} GROUP BY tree, idx // 16)"
        )
        ctes.append(
            f"{name}{k + 1} AS (SELECT tree, run AS idx, CASE WHEN n = 1 THEN hashes[1] ELSE sha256(array_to_string(hashes, '')) END AS hash, "
            f"(n + 15) // 16 AS n FROM {name}_run{k})"
        )
    sides = []
    for k in range(LEVELS):
        place = f"(t.idx // {16**k}) % 16"
        sides.append(f"CASE WHEN r{k}.n > 1 THEN array_to_string(r{k}.hashes[1:{place}], '') END")
        sides.append(f"CASE WHEN r{k}.n > 1 THEN array_to_string(r{k}.hashes[{place} + 2:16], '') END")
    joins = " ".join(f"JOIN {name}_run{k} r{k} ON r{k}.tree = t.tree AND r{k}.run = t.idx // {16 ** (k + 1)}" for k in range(LEVELS))
    ctes.append(f"{name}_up AS (SELECT t.*, [{', '.join(sides[0::2])}] AS lefts, [{', '.join(sides[1::2])}] AS rights FROM {name}0 t {joins})")
    return ctes


def merkle() -> str:
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        f"d AS (SELECT doc_id, source, {_leaf('text')} AS hash, CASE WHEN {crc32('doc_id::VARCHAR')} % 5 = 0 THEN {_leaf(low)} ELSE {_leaf('text')} END AS claim FROM documents)",
        *_tree(
            "leaf",
            "SELECT coalesce('s' || source, '') AS tree, doc_id, claim, hash, count(*) OVER (PARTITION BY source) AS n, "
            "row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, hash) - 1 AS idx FROM d",
        ),
        *_tree(
            "sub",
            f"SELECT '' AS tree, tree AS of_tree, hash, count(*) OVER () AS n, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx FROM leaf{LEVELS}",
        ),
    ]
    # each fold is a step of its own, so that no expression repeats the one before
    steps, held = [], "joined"
    ctes.append(
        f"joined AS (SELECT l.doc_id, l.hash AS leaf, s.hash AS subroot, (SELECT hash FROM sub{LEVELS}) AS root, l.claim AS h, "
        "list_concat(l.lefts, s.lefts) AS lefts, list_concat(l.rights, s.rights) AS rights FROM leaf_up l JOIN sub_up s ON s.of_tree = l.tree)"
    )
    for k in range(1, 2 * LEVELS + 1):
        new = f"CASE WHEN lefts[{k}] IS NULL THEN h ELSE sha256(lefts[{k}] || h || rights[{k}]) END"
        steps.append(f"fold{k} AS (SELECT * REPLACE ({new} AS h) FROM {held})")
        held = f"fold{k}"
    beside = "sha256(array_to_string(list_transform(range(1, len(lefts) + 1), lambda i: coalesce(lefts[i] || rights[i], '')), ''))"
    return (
        f"WITH {', '.join([*ctes, *steps])} SELECT doc_id, leaf, subroot, root, {beside} AS proof_sha256, h AS folded_root, "
        f"h = root AS verified FROM {held}"
    )


def hard_negatives() -> str:
    return """
    WITH kept AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), once AS (
      SELECT vec_id, min({'label': label, 'v': v}) AS r FROM kept GROUP BY vec_id
    ), c AS (
      SELECT vec_id, r.label AS label, r.v AS v FROM once
    ), scored AS (
      SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same,
             list_inner_product(a.v, c.v)::BIGINT AS score
      FROM c AS a JOIN c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
    ), p AS (
      SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
    )
    SELECT p.anchor_id, p.positive_id,
           row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank,
           s.other_id AS negative_id, p.positive_score, s.score AS negative_score
    FROM p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
     AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
    QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 5
    """
