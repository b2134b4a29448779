"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeats, clashing column names."""
import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id long, len int, full string, "
          "kept boolean, size long, comp long, token long, cell int, score double, n_tokens long")
WORDS = ("alpha beta gamma delta the of and to river stone Mountain window, garden; paper! silver? cloud "
         "Straße été niño 漢字 don't it's 42 1999 x_y").split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + (str(rnd.randint(0, 999)) if rnd.random() < 0.5 else "") for _ in range(n))


def documents():
    """Rows (doc_id, text, lang, source)."""
    rnd = random.Random(5)
    base = [prose(rnd, rnd.randint(6, 120)) for _ in range(30)]
    texts = [None, "", "   \t\n", "\x0b\x0c\r", "one", "one two three four", "One  two\tthree four\n",
             "one two three four five", prose(rnd, 30_000), "a" * 5000, " " * 300 + "x", "\x1c\x85  odd spaces 　"]
    texts += base + [base[0], base[0].upper(), " " + base[1] + "\n", base[2].replace(" ", "  ")]
    for b in base[3:18]:                # near copies on both sides of the threshold
        w = b.split()
        for _ in range(3):
            v = list(w)
            for _ in range(max(1, len(v) // rnd.choice((20, 40, 60)))):
                v[rnd.randrange(len(v))] = "edit%d" % rnd.randint(0, 9999)
            texts.append(" ".join(v))
    rows = [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["a", "b", "c", None])) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    return rows


def frame(spark, rows, parts=4):
    """A frame of the rows, with extra columns whose names operators use inside."""
    more = (None, 7, "x", False, 1, -1, 3, 9, 0.5, None)
    return spark.createDataFrame([(i, t, la, s, len(t or ""), *more) for i, t, la, s in rows], SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]
