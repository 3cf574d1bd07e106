"""Brute force for the extraction tests: blocks straight from the standard library's parser events, without a tree.

Every boundary gives a line end of its own; as white space is collapsed in the end, none
has to be held back. So this says nothing about attributions, which go by lines; quotes
are tested by literal cases.
"""

from html.parser import HTMLParser

from cadenza.operators import extract as X


class Blocks(HTMLParser):
    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.open, self.count, self.said = [], 0, {}  # said: (number, name) of a block -> {list item, or None: its text}
        self.paths = []  # (open elements, text), with runs of one path joined
        self.feed(html)
        self.close()

    def say(self, text, of_list=False):
        if any(silent for _, _, silent in self.open):
            return
        block = next(((number, name) for number, name, _ in self.open if name in X.BLOCKS), None)
        if block is None:
            return
        owners = [None]
        if block[1] in X.LISTS:
            names = [name for _, name, _ in self.open]
            innermost = max(i for i, name in enumerate(names) if name in X.LISTS)
            owners = [] if of_list else [number for number, name, _ in self.open[innermost:] if name == "li"]
        parts = self.said.setdefault(block, {})
        for owner in owners:
            parts[owner] = parts.get(owner, "") + text

    def boundary(self, name, silent):
        if name in X.BREAKING and not silent:
            self.say("\n", name in X.LISTS)

    def handle_starttag(self, name, attrs):
        self.count += 1
        silent = name in X.SILENT or X.CARD in (dict(attrs).get("class") or "").split()
        if name == "br":
            self.say("\n")
        self.boundary(name, silent)
        if name not in X.VOID:
            self.open.append((self.count, name, silent))

    def handle_startendtag(self, name, attrs):
        self.handle_starttag(name, attrs)
        if name not in X.VOID:
            self.handle_endtag(name)

    def handle_endtag(self, name):
        if name in [n for _, n, _ in self.open]:
            last = None
            while last != name:
                _, last, silent = self.open.pop()
                self.boundary(last, silent)

    def handle_data(self, data):
        self.say(data)
        path = [name for _, name, _ in self.open]
        if self.paths and self.paths[-1][0] == path:
            data = self.paths.pop()[1] + data
        self.paths.append((path, data))


def blocks(html):
    """(type, level, text) of every block that has text."""
    out = []
    for (_, name), parts in sorted(Blocks(html).said.items()):
        kind = "list" if name in X.LISTS else {"p": "paragraph", "blockquote": "quote"}.get(name, "heading")
        texts = [" ".join(text.split()) for _, text in sorted(parts.items())]
        out.append((kind, int(name[1]) if kind == "heading" else None, ". ".join(t for t in texts if t)))
    return [b for b in out if b[2]]
