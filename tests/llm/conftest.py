import pandas as pd
import pytest

LONG = " ".join(f"w{i}" for i in range(30))


def texts():
    import random

    rng, out = random.Random(4), []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(40)]
    for c in range(14):
        base = [word() for _ in range(rng.choice([6, 30, 90]))]
        for _ in range(rng.choice([1, 3, 7])):
            cur = list(base)
            for _ in range(rng.randint(0, max(1, len(cur) // 25))):
                cur[rng.randrange(len(cur))] = word()
            if rng.random() < 0.3:
                cur += passage
            cut = rng.randrange(len(cur))
            out.append(" ".join(cur[:cut]) + "\n" + " ".join(cur[cut:]))
    out += [None, "", " ", "one", "ONE", "one  two\tthree four", "one two three four", "é" * 300, "漢字 " * 60, "a" * 250, "a" * 250, "x\n" * 40, LONG, LONG]
    out.append("x " * 20000)
    return out


def write(folder, empty=False):
    rows = [] if empty else texts()
    n = len(rows)
    docs = pd.DataFrame({"doc_id": pd.array([(i * 37) % 1009 for i in range(n)], "Int64"), "text": pd.array(rows, "string")})
    docs["lang"] = pd.array([None if i % 5 == 0 else "en" if i % 2 else "fr" for i in range(n)], "string")
    docs["source"] = pd.array(["s"] * n, "string")
    docs["n_chars"] = pd.array([len(t or "") for t in rows], "Int64")
    for extra in ("score", "n_lines", "kept", "row", "d", "k", "id", "key"):  # names that operators use themselves
        docs[extra] = pd.array(["?"] * n, "string")
    if not empty:
        docs = pd.concat([docs, docs.iloc[[3]], docs.iloc[[4]].assign(doc_id=pd.NA)], ignore_index=True)
    docs.to_parquet(f"{folder}/documents.parquet")
    labels = docs[["doc_id"]].iloc[::2].assign(quality=pd.array([i % 3 != 0 for i in range(len(docs.iloc[::2]))], "Int32"), toxic=pd.array([0] * len(docs.iloc[::2]), "Int32"))
    labels.to_parquet(f"{folder}/labels.parquet")
    items = [] if empty else [None, "", "short", LONG + " tail", rows[0] or "", " ".join(f"w{i}" if i != 9 else "changed" for i in range(30))]
    pd.DataFrame({"item_id": pd.array(range(len(items)), "Int64"), "text": pd.array(items, "string")}).to_parquet(f"{folder}/benchmark.parquet")
    body = "<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><a href='/x'>Menu</a></nav>%s<footer>(c)</footer></body>"
    html = [] if empty else [None, "", "plain &amp; text", body % "<div class='ad'>Buy</div><article><h1>Head</h1><p>One<b>two</b>&lt;<br>three<p>four</article>"]
    html += [] if empty else [body % f"<article><p>Page {i}</p><div class='comments'>no</div></article>" for i in range(12)]
    urls = pd.array([None if i == 1 else f"http://h.example/{i}" for i in range(len(html))], "string")
    pd.DataFrame({"page_id": pd.array(range(len(html)), "Int64"), "url": urls, "html": pd.array(html, "string")}).to_parquet(f"{folder}/pages.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def edge_dir(tmp_path_factory):
    return write(tmp_path_factory.mktemp("edge"))


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory):
    return write(tmp_path_factory.mktemp("empty"), empty=True)
