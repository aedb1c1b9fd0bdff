"""SQL for those queries of this folder that SQL can express."""

#: Every distinct shingle of every document, all pairs that share one, and all that each document can reach.
NEAR_DUPLICATES = r"""
with recursive words as (
    select doc_id, list_filter(
        regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x20\x09-\x0D]+'),
        lambda x: x <> '') as w
    from documents
), shingles as (
    select doc_id, unnest(list_distinct(case
        when len(w) = 0 then []
        when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end)) as shingle
    from words
), sizes as (
    select doc_id, count(*) as n from shingles group by doc_id
), common as (
    select a.doc_id as a, b.doc_id as b, count(*) as n
    from shingles a join shingles b on a.shingle = b.shingle and a.doc_id < b.doc_id
    group by 1, 2
), links as (
    select a, b from common
    join sizes x on x.doc_id = a join sizes y on y.doc_id = b
    where 100 * common.n >= 75 * (x.n + y.n - common.n)
), edges as (
    select a, b from links union all select b, a from links
), reach as (
    select doc_id, doc_id as other from documents
    union
    select reach.doc_id, edges.b from reach join edges on reach.other = edges.a
)
select d.doc_id, coalesce(s.n, 0) as n_shingles, r.component_id, d.doc_id = r.component_id as kept
from documents d
left join sizes s on s.doc_id = d.doc_id
join (select doc_id, min(other) as component_id from reach group by doc_id) r on r.doc_id = d.doc_id
"""

#: The exponent by bisection in a recursive query; the draws by running totals over whole passes, without blocks.
MIXING = r"""
with recursive texts as (
    select doc_id, coalesce('s:' || source, 'n') as source_key,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as n
    from documents
), docs as (
    select doc_id, source_key, sum(n)::bigint as n_tokens from texts where n > 0 group by all
), totals as (
    select source_key, sum(n_tokens)::bigint as tokens from docs group by 1
), shares as (
    select sum(tokens)::bigint as total, list(tokens order by source_key) as ts from totals
), p as (
    select total, list_transform(ts, lambda t: t::double / total) as q from shares
), warm as (
    select 0 as i, 0::double as low, 1::double as high, total, q from p
    union all
    select i + 1, if(ok, m, low), if(ok, high, m), total, q from (
        select *, (ln(mass) - m * list_sum(list_transform(q, lambda x: pow(x, m) * ln(x))) / mass)
            >= 0.95 * ln(len(q)) as ok
        from (select *, list_sum(list_transform(q, lambda x: pow(x, m))) as mass
            from (select *, (low + high) / 2 as m from warm where i < 40)))
), spare as (
    select 0 as i, 0::double as low, 1::double as high, q from p
    union all
    select i + 1, if(ok, low, m), if(ok, m, high), q from (
        select *, list_max(list_transform(q, lambda x: pow(x, m - 1)))
            / list_sum(list_transform(q, lambda x: pow(x, m))) <= 4.0 as ok
        from (select *, (low + high) / 2 as m from spare where i < 40))
), ends as (
    select total, q,
        -list_sum(list_transform(q, lambda x: x * ln(x))) >= 0.95 * ln(len(q)) as as_is,
        list_max(list_transform(q, lambda x: 1 / x)) / len(q) <= 4.0 as is_flat
    from p
), exponent as (
    select total, q, greatest(
        if(as_is, 1, (select low from warm where i = 40)),
        if(is_flat, 0, (select high from spare where i = 40))) as a
    from ends
), quotas as (
    select source_key, tokens, ceil(tokens / 100000.0)::bigint as blocks,
        floor(total * (pow(tokens::double / total, a) / list_sum(list_transform(q, lambda x: pow(x, a)))))::bigint
            as quota
    from totals, exponent
), dealt as (
    select doc_id, source_key, n_tokens, tokens, blocks, quota, pass_no,
        md5(pass_no || ':' || coalesce(doc_id::varchar, 'null')) as order_key
    from (select *, unnest(range(0, (quota - 1) // tokens + 1)) as pass_no
        from docs join quotas using (source_key) where quota > 0)
), placed as (
    select *, ('0x' || substr(order_key, 1, 8))::bigint * blocks // 4294967296 as block_no,
        (pass_no * tokens + sum(n_tokens) over (partition by source_key, pass_no order by order_key) - n_tokens)::bigint
            as tokens_before
    from dealt
)
select doc_id, source_key, pass_no, block_no, n_tokens, tokens_before, quota from placed where tokens_before < quota
"""

#: Brute force over all pairs of a query and a row, on the signs of the vectors themselves.
CODE_SEARCH = """
select query_id, rank, neighbor_id, distance from (
    select *, row_number() over (partition by query_id order by distance, neighbor_id) as rank from (
        select q.vec_id as query_id, v.vec_id as neighbor_id,
            list_sum(list_transform(range(1, 65), lambda i: ((q.embedding[i] > 0) <> (v.embedding[i] > 0))::int))::int
                as distance
        from embeddings q, embeddings v where q.vec_id % 100 = 0))
where rank <= 10
"""

#: Every revisit against all full responses of its URL, the latest of which counts.
REVISITS = r"""
with captures as (
    select page_id as n, 1700000000 + page_id as seen, md5(coalesce(html, '')) as tag,
        'day ' || ((page_id % 400) + 400) % 400 as modified, length(coalesce(html, '')) as size,
        regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as plain
    from pages
), parts as (
    select *, lower(regexp_extract(plain, '^[^/?]*')) as raw_host, regexp_replace(plain, '^[^/?]*', '') as rest
    from captures
), urls as (
    select *,
        regexp_replace(regexp_replace(regexp_replace(raw_host, '^.*@', ''), '^www[0-9]*\.', ''), ':(80|443)?$', '')
            as host,
        regexp_replace(regexp_extract(rest, '^[^?]*'), '/+$', '') as path,
        list_sort(list_filter(string_split(regexp_replace(rest, '^[^?]*[?]?', ''), '&'),
            lambda x: x <> '' and not regexp_full_match(lower(x), '(utm_[a-z]*|ref|fbclid|gclid)(=.*)?'))) as params
    from parts
), pages_in as (
    select n, seen, tag, modified, size,
        host || path || if(len(params) > 0, '?' || array_to_string(params, '&'), '') as url
    from urls
), full_responses as (
    select 4 * n as id, url, seen, '"' || tag || '"' as etag, modified, tag as digest,
        ['content-length: ' || size, 'content-type: text/html', 'last-modified: ' || modified] as other
    from pages_in
    union all
    select 4 * n + 1, url, seen + 5000000, 'W/"2-' || tag || '"', null, md5('2' || tag), ['server: second']
    from pages_in where n % 3 = 0
), revisits as (
    select 4 * n + 2 as id, url,
        seen + case when n % 11 = 0 then -1 when n % 2 = 0 then 2000000 else 9000000 end as seen,
        case when n % 7 = 0 then null when n % 3 = 0 and n % 2 = 1 and n % 5 <> 0 then '"2-' || tag || '"'
            else '"' || tag || '"' end as etag,
        case when n % 7 = 0 then modified end as modified
    from pages_in
), met as (
    select v.id as record_id, v.url, f.id as referred_id, f.digest, f.etag as old_tag, f.modified as old_modified,
        f.other, v.etag, v.modified,
        row_number() over (partition by v.id order by f.seen desc nulls last, f.id desc) as place
    from revisits v left join full_responses f on f.url = v.url and f.seen < v.seen
), judged as (
    select *, coalesce(regexp_replace(old_tag, '^W/', '') = regexp_replace(etag, '^W/', ''), old_modified = modified) as ok
    from met where place = 1
), stated as (
    select *, case when referred_id is null then 'no_earlier_response' when ok then 'resolved'
        when not ok then 'validator_mismatch' else 'no_validator' end as status
    from judged
)
select record_id, url, referred_id, status,
    if(status in ('resolved', 'no_validator'), digest, null) as payload_digest,
    if(status in ('resolved', 'no_validator'), array_to_string(list_sort(list_concat(
        list_filter(other, lambda x: modified is null or not starts_with(x, 'last-modified')),
        ['cache-control: max-age=9', 'etag: ' || coalesce(etag, old_tag)],
        if(modified is null, [], ['last-modified: ' || modified]))), chr(10)), null) as headers
from stated
"""

#: Windows of items and every position of a document where one begins, compared as word lists.
DECONTAMINATION = r"""
with docs as (
    select row_number() over () as rid, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from documents
), items as (
    select item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from benchmark where item_id is not null
), starts as (
    select item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) as i from items where len(w) > 0
), windows as (
    select distinct item_id, if(len(w) < 10, w, w[i:i + 9]) as win from starts
), places as (
    select rid, w, unnest(range(1, len(w) + 1)) as pos from docs
), found as (
    select p.rid, p.pos, x.item_id, len(x.win) as k
    from places p join windows x on x.win[1] = p.w[p.pos] and p.w[p.pos:p.pos + len(x.win) - 1] = x.win
), hit as (
    select rid, count(distinct q) as n_hit from (select rid, unnest(range(pos, pos + k)) as q from found) group by rid
), named as (
    select rid, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids
    from (select distinct rid, item_id from found) group by rid
)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(h.n_hit, 0)::bigint as n_hit,
    coalesce(n.n_items, 0)::bigint as n_items, sha256(coalesce(n.ids, '')) as items_sha256,
    coalesce(h.n_hit, 0) > 0 as contaminated
from docs d left join hit h on h.rid = d.rid left join named n on n.rid = d.rid
"""

ORACLE: dict[str, str] = {
    "op1_near_duplicates": NEAR_DUPLICATES,
    "op6_mixing": MIXING,
    "op8_revisits": REVISITS,
    "op9_code_search": CODE_SEARCH,
    "op13_decontamination": DECONTAMINATION,
}
