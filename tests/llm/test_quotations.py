import itertools
import random
import re

from bibweave.llm.quotations import link_quotations


def test_links_levels_and_threads(spark):
    rows = [
        (1, 0, "user", "Where is the shelf?\nI can't see it."),
        (1, 1, "assistant", "> where is  the shelf?\n> I can't see it.\nBehind the door."),
        (1, 2, "user", ">> Where is the shelf?\n>> I can't see it.\n> Behind the door.\nThanks."),
        (1, 3, "user", "> I can't see it.\nStill not."),
        (1, 4, None, None),
        (2, 0, "user", "> Behind the door.\n> > nobody said this\nWhich one?"),
        (2, None, "user", "x"),
        (2, 1, "user", "> \n"),
    ]
    got = {(r.conv_id, r.turn): r for r in link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == len(rows)
    assert got[1, 0].own_text == "Where is the shelf?\nI can't see it." and got[1, 0].n_quotes == 0
    assert (got[1, 1].reply_to, got[1, 1].own_text) == (0, "Behind the door.")
    assert (got[1, 2].reply_to, got[1, 2].n_linked, got[1, 2].max_level, got[1, 2].thread_root, got[1, 2].thread_depth) == (1, 2, 2, 0, 2)
    assert (got[1, 3].reply_to, got[1, 3].thread_root, got[1, 3].thread_depth) == (0, 0, 1)
    assert [got[1, t].reply_index for t in (0, 1, 2, 3)] == [1, 2, 3, 4]
    assert (got[1, 4].own_text, got[1, 4].thread_root, got[1, 4].reply_index) == ("", 4, 1)
    assert (got[2, 0].n_linked, got[2, 0].n_linked_elsewhere, got[2, 0].reply_to) == (0, 1, None)
    assert got[2, None].own_text == "x" and got[2, 1].n_linked == 0


def test_repeats_clashes_and_empty(spark):
    rows = [(1, 0, "u", "a b", 9), (1, 0, "u", "a b", 9), (1, 1, "u", "> a b\nc", 9)]
    got = link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key int"))
    assert sorted((r.turn, r.reply_to, r.reply_index) for r in got.collect()) == [(0, None, 1), (0, None, 2), (1, 0, 3)]
    assert link_quotations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_trimmed_quotes_other_conversations_and_nulls(spark):
    rows = [
        (1, 0, "u", "one fish\ntwo fish\nred fish\nblue fish\nold fish"),
        (1, 1, "a", "> two fish\n> red fish\nWhich ones?"),
        (1, 2, "u", "> one fish\n> [...]\nx\n> one fish\n>\n> old fish\ny"),
        (2, 0, "u", "> red fish\n> blue fish\nI read this elsewhere."),
        (3, 0, "u", "> said there later\nz"),
        (3, 1, "a", "said there later"),
        (4, 5, "u", "said there later"),
        (None, 0, "u", "left out"),
        (None, 1, "a", "> left out\nyes"),
        (5, None, "u", "> one fish\nw"),
    ]
    got = {(r.conv_id, r.turn): r for r in link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == len(rows)
    assert (got[1, 1].n_linked, got[1, 1].reply_to, got[1, 1].thread_root) == (1, 0, 0)
    assert (got[1, 2].n_quotes, got[1, 2].n_linked, got[1, 2].reply_to) == (2, 1, 0)
    assert (got[2, 0].n_linked, got[2, 0].n_linked_elsewhere) == (0, 1)
    assert (got[3, 0].n_linked, got[3, 0].n_linked_elsewhere) == (0, 1)
    assert (got[None, 1].n_linked, got[None, 1].reply_to, got[None, 1].thread_depth, got[None, 1].reply_index) == (1, 0, 1, 2)
    assert got[5, None].n_linked_elsewhere == 1


def norm(text):
    return " ".join(re.sub("[ \t\n\x0b\f\r]+", " ", text.lower()).split(" ")).strip()


def brute(rows):
    """The docstring's rules, message by message."""
    parsed = []
    for conv, turn, _, text in rows:
        lines = []
        for line in (text or "").split("\n"):
            marks = re.match(r"(?:[ \t]*>)+", line)
            lines.append(((marks.group().count(">") if marks else 0), (line[marks.end() :] if marks else line).strip(" ")))
        runs = [(level, "\n".join(b for _, b in part)) for level, part in ((k, list(g)) for k, g in itertools.groupby(lines, key=lambda x: x[0]))]
        own = "\n".join(b for level, b in lines if level == 0 and b)
        own_lines = {norm(b) for b in own.split("\n")} - {""}
        said = ({norm(own)} | {norm(b) for level, b in runs if level == 0} | own_lines) - {""}
        quotes = [(level, norm(b), [norm(x) for x in b.split("\n") if norm(x)]) for level, b in runs if level > 0]
        parsed.append((conv, turn, own, said, own_lines, quotes, max(level for level, _ in lines)))

    def says(m, quote):
        return quote[1] in m[3] or (len(set(quote[2])) > 1 and set(quote[2]) <= m[4])

    per = {}
    for conv, turn, _, _, _, quotes, _ in parsed:
        linked, elsewhere, reply = per.get((conv, turn), (0, 0, None))
        hits = []
        for nr, q in enumerate(quotes):
            if not q[1]:
                continue
            here = [m[1] for m in parsed if m[0] == conv and m[1] is not None and says(m, q)]
            other = [m[0] for m in parsed if m[0] is not None and m[0] != conv and says(m, q)]
            if turn is not None and here and min(here) < turn:
                linked += 1
                if q[0] == 1:
                    hits.append((nr, min(here)))
            elif other:
                elsewhere += 1
        best = min(hits + ([reply] if reply else []), default=None)
        per[conv, turn] = (linked, elsewhere, best)
    out = []
    for conv, turn, own, _, _, quotes, level in parsed:
        linked, elsewhere, reply = per[conv, turn]
        root, depth, at = turn, 0, reply
        while at:
            root, depth, at = at[1], depth + 1, per[conv, at[1]][2]
        out.append((conv, turn, own, len(quotes), level, linked, elsewhere, reply and reply[1], root, depth))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(11)
    pool = [" ".join(rng.choice(["red", "blue", "old", "new", "fish", "Fish", "  two"]) for _ in range(rng.randint(1, 4))) for _ in range(25)]
    rows = []
    for conv in (1, 2, 3, None):
        past = []
        for turn in range(9):
            body = [rng.choice(pool) for _ in range(rng.randint(0, 4))]
            if past and rng.random() < 0.8:
                quoted = rng.choice(past).split("\n")
                a = rng.randrange(len(quoted))
                cut = quoted[a : a + rng.randint(1, 3)]
                body = [("> " if rng.random() < 0.7 else ">") + x for x in cut] + body
            if rng.random() < 0.2:
                body.insert(rng.randrange(len(body) + 1), "> > " + rng.choice(pool))
            text = None if rng.random() < 0.05 else "\n".join(body)
            rows.append((conv, None if rng.random() < 0.05 else turn, "u", text))
            past.append(text or "")
    rows += [rows[4], rows[13]]
    long = "\n".join(f"line {k} of a long message" for k in range(10_000))
    rows += [(9, 0, "u", long), (9, 1, "a", "\n".join("> " + x for x in long.split("\n")[2000:4000]) + "\nyes"), (9, 2, "u", "\n".join(">" * (k % 3) + f" x{k}" for k in range(9000)))]
    got = link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    names = ["conv_id", "turn", "own_text", "n_quotes", "max_level", "n_linked", "n_linked_elsewhere", "reply_to", "thread_root", "thread_depth"]
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr) == sorted(brute(rows), key=repr)
