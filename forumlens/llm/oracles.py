"""DuckDB SQL for the corpus queries that SQL can express, over the tables as views."""

from __future__ import annotations


def _vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Plain Lloyd rounds: every part against every entry, a CTE for each round."""
    steps = []
    for k in range(rounds + 1):
        steps.append(
            f"""found{k} as materialized (select r, part, arg_min(entry, d * {entries} + entry) as entry, min(d) as d from
                (select v.r, v.part, b.entry, sum((v.x - b.x) * (v.x - b.x)) as d from vals v join book{k} b on b.part = v.part and b.pos = v.pos
                 group by 1, 2, 3) group by 1, 2)"""
        )
        if k < rounds:
            steps.append(
                f"""book{k + 1} as materialized (select b.part, b.entry, b.pos, coalesce(m.x, b.x) as x from book{k} b left join
                (select f.part, f.entry, v.pos, cast(floor(cast(sum(v.x) as double) / count(*)) as bigint) as x from found{k} f
                 join vals v on v.r = f.r and v.part = f.part group by 1, 2, 3) m on m.part = b.part and m.entry = b.entry and m.pos = b.pos)"""
            )
    return f"""with kept as materialized (select row_number() over (order by vec_id) as r, vec_id, label, embedding from embeddings
            where embedding is not null and list_count(embedding) = len(embedding) and isfinite(list_sum(embedding))),
        vals as materialized (select r, (i - 1) // (len(embedding) // {parts}) as part, (i - 1) % (len(embedding) // {parts}) as pos,
            cast(floor({scale} * cast(embedding[i] as double)) as bigint) as x from (select r, embedding, unnest(range(1, len(embedding) + 1)) as i from kept)),
        book0 as materialized (select part, r - 1 as entry, pos, x from vals where r <= {entries}),
        {", ".join(steps)},
        codes as (select r, string_agg(printf('%02x', entry), '' order by part) as code, cast(sum(d) as bigint) as error from found{rounds} group by 1)
        select k.vec_id, c.code, c.error, cast(sum(c.error) over (partition by k.label) as bigint) as label_error,
            sha256((select string_agg(cast(x as varchar), ',' order by part, entry, pos) from book{rounds})) as codebooks_sha256
        from kept k join codes c on c.r = k.r"""


def _substring_dedup(size: int = 13) -> str:
    return rf"""with docs as materialized (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        windows as materialized (select r, doc_id, k, md5(array_to_string(list_slice(w, k, k + {size - 1}), ' ')) as s
            from (select r, doc_id, w, unnest(range(1, greatest(1, len(w) - {size - 2}))) as k from docs)),
        firsts as (select s, min(doc_id) as low from windows group by 1),
        gone as materialized (select distinct r, k + j as p from (select r, k, unnest(range({size})) as j from windows join firsts using (s) where low < doc_id)),
        rest as (select r, count(*) as n, string_agg(word, ' ' order by p) as kept
            from (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from docs) anti join gone using (r, p) group by 1)
        select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
        from docs left join rest using (r)"""


ORACLES = {"op11_vector_codes": _vector_codes(), "op12_substring_dedup": _substring_dedup()}
