import hashlib, zlib
def H(s): return hashlib.sha256(s.encode()).hexdigest()
def field(v):
    if v is None: return '-'
    t = str(v); return f"{len(t.encode())}:{t}"
def leaf(r): return H(''.join(field(r[k]) for k in ('doc_id','source','lang','n_chars','text')))
def tree(nodes):
    """returns top, and per node index list of (slot, siblings)"""
    paths = [[] for _ in nodes]; members = [[i] for i in range(len(nodes))]
    level = list(nodes)
    while len(level) > 1:
        nxt = []; nmembers = []
        for j in range(0, len(level), 3):
            run = level[j:j+3]
            for s in range(len(run)):
                for leafi in members[j+s]:
                    paths[leafi].append((s, run[:s]+run[s+1:]))
            nxt.append(H(''.join(run)))
            nmembers.append([x for k in range(j, min(j+3, len(level))) for x in members[k]])
        level = nxt; members = nmembers
    return level[0], paths
def manifest(rows):
    rows = [dict(r) for r in rows]
    for r in rows: r['leaf'] = leaf(r)
    groups = {}
    for r in rows: groups.setdefault(r['source'], []).append(r)
    keys = sorted(groups, key=lambda k: (k is not None, (k or '').encode()))
    subs = []
    for k in keys:
        g = sorted(groups[k], key=lambda r: (r['doc_id'] is not None, r['doc_id'] or 0, r['leaf']))
        top, paths = tree([r['leaf'] for r in g])
        for r, p in zip(g, paths): r['path'] = p; r['subroot'] = top
        subs.append(top)
    root, upaths = tree(subs)
    for k, up in zip(keys, upaths):
        for r in groups[k]: r['path'] = r['path'] + up; r['root'] = root
    out = []
    for r in rows:
        sibs = ''.join(h for _, s in r['path'] for h in s)
        t = r['text']
        if r['doc_id'] is not None and zlib.crc32(str(r['doc_id']).encode()) % 2 == 0 and t is not None:
            t = t.replace('\n', '')
        acc = leaf({**r, 'text': t})
        for s, sib in r['path']:
            acc = H(''.join(sib[:s] + [acc] + sib[s:]))
        out.append((r['doc_id'], r['leaf'], r['subroot'], r['root'], H(sibs), acc, acc == r['root']))
    return out
