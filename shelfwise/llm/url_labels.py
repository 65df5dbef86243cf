"""A labelled table of URLs, put together from general vocabulary by a rule; none of its hosts comes from the tables that are judged.

An unwanted host joins a word of unwanted trades to a neutral or a luring one, an ordinary host an ordinary word to the same neutral ones, with and
without a hyphen, so that neither hyphens nor neutral words tell the classes apart. Every ``hold_out``-th neutral
partner is left out of the training part: those hosts measure what the model makes of names that it has not seen.
"""

from __future__ import annotations

# fixed values: words of trades that a corpus of text does without, by trade
UNWANTED = (
    "casino poker roulette jackpot slots blackjack bingo gambling betting bets wager lottery "
    "pills meds pharma viagra cialis steroids tramadol dosage "
    "porn xxx adult sex escort camgirls nude webcam "
    "ads adserver popups banner tracker track clicks affiliate "
    "spam scam phishing malware warez cracks keygen torrent "
    "loans payday forex crypto bitcoin replica fakes"
).split()
# fixed values: words that unwanted sites lure with
LURES = "cheap free win bonus instant hot discount cash prize secret quick unlimited".split()
# fixed values: words of ordinary sites
ORDINARY = (
    "library museum weather garden physics recipes archive history school science music theatre gazette maps travel nature "
    "history city news village council parish station railway harbour bridge river forest mountain island farm bakery "
    "kitchen cooking family children health clinic hospital dentist doctor pharmacy sports football tennis chess cycling running "
    "film photo paint poetry novel author books journal review essay letter language grammar dictionary wiki forum "
    "linux python compiler kernel network database research institute university college student teacher course lecture "
    "market budget bank insurance law court justice police energy water climate planet astronomy biology chemistry"
).split()
# fixed values: words of ordinary names that are no trade at all
FIRST = (
    "old green little north south east west blue golden silver bright calm deep early fresh gentle high long lower upper "
    "royal round sunny tall warm white wild wooden young red black brown amber crystal stone iron copper velvet rapid "
    "central local public national modern classic simple open clear honest lucky happy merry brave"
).split()
SECOND = (
    "valley field orchard harvest lantern candle window basket carpet ladder engine wheel bicycle feather pebble shore coast "
    "cliff canyon prairie glacier volcano thunder rainbow sunset morning evening winter summer autumn spring maple willow "
    "cedar birch rabbit falcon otter badger beaver heron sparrow whale dolphin tiger elephant teapot saddle anchor compass "
    "castle tower abbey chapel cottage tavern workshop mill quarry foundry loom pottery quilt violin trumpet piano choir "
    "ballet opera circus puppet sculpture mosaic marble ribbon button needle thread pencil notebook envelope stamp"
).split()
# fixed values: words that say nothing, used by both classes
NEUTRAL = "best online my top web site club world net blog shop house place point group daily home land".split()
PREFIXES = ("", "www.", "m.", "blog.")
PATHS = ("/en/{}", "/de/{}.html", "/fr/{}/", "/es/{}", "/{}/index.html", "")
SYLLABLES = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "ti", "is", "it", "ar", "st")


def _hosts(words: list[str], partners: int) -> list[tuple[str, int]]:
    """(host name, number of its neutral partner within the word): each word with so many neutral ones."""
    out = []
    for i, w in enumerate(dict.fromkeys(words)):
        for j in range(partners):
            other = NEUTRAL[(5 * i + 7 * j) % len(NEUTRAL)]
            name = (f"{w}-{other}", f"{other}{w}", f"{other}-{w}", f"{w}{other}")[(i + j) % 4]
            out.append((name, j))
    return out


def _coined(number: int) -> list[str]:
    """Names of three or four syllables that mean nothing, as small ordinary sites often have."""
    n = len(SYLLABLES)
    return ["".join(SYLLABLES[(k * 7 + m * (k // n + 3)) % n] for m in range(3 + k % 2)) for k in range(number)]


def _lured(lures: int) -> list[str]:
    """Each unwanted word with so many luring ones."""
    both = ((w, LURES[(5 * i + 7 * j + 3) % len(LURES)], i + j) for i, w in enumerate(dict.fromkeys(UNWANTED)) for j in range(lures))
    return [(f"{b}-{a}", f"{a}{b}", f"{b}{a}", f"{a}-{b}")[k % 4] for a, b, k in both]


def _pairs(number: int) -> list[str]:
    """Names of two ordinary words, with and without a hyphen."""
    both = ((FIRST[k % len(FIRST)], SECOND[(k * 3 + k // len(FIRST)) % len(SECOND)]) for k in range(number))
    return list(dict.fromkeys(f"{a}-{b}" if k % 2 else f"{a}{b}" for k, (a, b) in enumerate(both)))


def rows(held_out: bool = False, hold_out: int = 4) -> list[tuple[str, int]]:
    """(url, label), 1 for unwanted: the training part, or the hosts left out of it."""
    hosts = [(h, j, 1) for h, j in _hosts(UNWANTED, 8)] + [(h, j, 0) for h, j in _hosts(ORDINARY, 4)]
    hosts += [(h, k, 0) for k, h in enumerate(dict.fromkeys(_coined(200)))]
    hosts += [(h, k, 0) for k, h in enumerate(_pairs(400))]
    hosts += [(h, k, 1) for k, h in enumerate(_lured(3))]
    out = []
    for k, (host, j, label) in enumerate(hosts):
        if (j % hold_out == hold_out - 1) == held_out:
            ending = ("example.com", "example.org", "example.net")[k % 3]
            path = PATHS[(k // 3) % len(PATHS)].format(k % 97)
            out.append((f"https://{PREFIXES[(k // 2) % len(PREFIXES)]}{host}.{ending}{path}", label))
    return out
