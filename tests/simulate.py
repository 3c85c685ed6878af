"""Grounding by priority queues with stale entries, written from the description alone; slow and plain, to hold the engine against."""

import heapq
import math
from collections import defaultdict


def ground(symbols, types, relations, starts, edges, kinds, similar, *, neighbors, decay, boost, answers, per_symbol, alternative):
    """{symbol: {node: (score, support)}}, in order of discovery."""
    score, support, seen = (defaultdict(dict) for _ in range(3))
    queue, done = defaultdict(list), defaultdict(set)
    score["ANSWER"]

    def push(s, n):
        heapq.heappush(queue[s], (-score[s][n], n) if alternative else (-support[s][n], -score[s][n], n))

    for s, n, x in starts:
        score[s][n], support[s][n], seen[s][n] = x, 1, set()
        push(s, n)
    around = defaultdict(list)
    for a, b, r in relations:
        around[a].append((b, r))
        around[b].append((a, r))
    eps = 1e-6 if alternative else 1e-9

    def likeness(s, nodes):
        if not types.get(s) or s not in similar:
            return [(n, 0.5) for n in nodes]
        if alternative:
            return [(n, similar[s].get(n, 0.5) if kinds[n] in types[s] else 0.5) for n in nodes]
        return [(n, similar[s][n]) for n in nodes if kinds[n] in types[s] and n in similar[s]]

    def blend(x, d):
        if x > eps and d > eps:
            return 2 * x * d / (x + d)
        if alternative:
            return 0.1
        return decay * x if x > eps else decay * d if d > eps else 0.1

    def expand(s, n):
        done[s].add(n)
        mine = score[s][n]
        for other, r in around[s]:
            for m, x in sorted(likeness(other, sorted(edges[n, r])), key=lambda p: -p[1])[:neighbors]:
                if m in done[other]:
                    continue
                triplet = (s, r, other)
                if m in score[other]:
                    if triplet in seen[other][m]:
                        continue
                    old = score[other][m]
                    seen[other][m].add(triplet)
                    support[other][m] += 1
                    score[other][m] = max(old, mine) * (1 + boost * math.log(support[other][m] + 1))
                    if not alternative or score[other][m] > old:
                        push(other, m)
                elif len(score[other]) < (answers if other == "ANSWER" else per_symbol):
                    score[other][m], support[other][m], seen[other][m] = blend(x, mine * decay), 1, {triplet}
                    push(other, m)

    waiting = [s for s in symbols if s != "ANSWER"]
    while True:
        moved, still = 0, []
        for s in waiting:
            if alternative and len(score[s]) >= per_symbol:
                continue
            while queue[s]:
                entry = heapq.heappop(queue[s])
                n = entry[-1]
                if abs(-entry[-2] - score[s][n]) > 1e-9 or (not alternative and (n in done[s] or -entry[0] != support[s][n])):
                    continue
                still.append(s)
                if n not in done[s]:
                    expand(s, n)
                    moved += 1
                break
        if alternative:
            waiting = still
        if len(score["ANSWER"]) >= answers or not moved:
            return {s: {n: (score[s][n], support[s][n]) for n in score[s]} for s in score}
