"""Labelled findings to train the secret filter on: made by rule from a seed, in the shapes that scanners report."""

from __future__ import annotations

import base64
import random
import string

# What stands before real secrets and before strings that only look like them.
SECRET_LEADS = ['token = "', "token: ", 'api_key = "', "apikey=", "API_KEY=", 'secret = "', "client_secret: '", "password = '", "passwd=",
                "AWS_SECRET_ACCESS_KEY=", "aws_access_key_id = ", "Authorization: Bearer ", 'auth_token = "', "private_key: ", 'access_token":"',
                "TOKEN = \"", "PASSWORD: ", "SECRET=\"", "credentials = '"]
PLAIN_LEADS = ["commit ", "sha256:", "sha1 = ", "md5: ", "checksum ", "etag: ", "uuid=", "id: ", "session ", "build ", "image@", "integrity ",
               "rev ", "digest: ", "order no ", "card ", "call ", "see ", "version ", "href=/", "file ", "the ", "and ", "of ", ", ", ""]
SECRET_PATHS = ["config/settings.py", ".env", "deploy/values.yaml", "src/app/client.js", "conf/prod.ini", "terraform/main.tf", ""]
PLAIN_PATHS = ["package-lock.json", "tests/fixtures/sample.txt", "docs/example.md", "go.sum", "assets/logo.svg", "README.md", "data/ids.csv", ""]
WORDS = ("access account address after application array available background before boolean branch browser button cache callback change channel "
         "child class click client column command comment commit component config connection console constant container content context control "
         "count create current database date debug default delete description detail device directory display document domain download driver "
         "element email enable engine entry error event example export false field file filter first folder format frame function global graph group "
         "handler header height hello hidden history image import index info input insert instance integer internal item key language layout length "
         "level library line link list loader local location login main manager master memory menu message method model module mouse name network "
         "node note number object offset option order output package page panel parameter parent parse password path pattern person place player "
         "plugin point position prefix private process profile project property protocol provider public query queue random range record region "
         "registry remote render replace report request resource response result return route sample schema scroll search second secret section "
         "select sequence server service session setting shared simple size source stack standard start state static status stream string style "
         "subject submit suffix switch symbol system table target template test text thread time title token toggle total trace transform tree true "
         "type undefined unique update upload user utility value variable version video view virtual volume widget width window worker wrapper").split()


def _secret(r: random.Random) -> str:
    hexes, plain = "0123456789abcdef", string.ascii_letters + string.digits
    take = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    kind = r.randrange(10)
    if kind < 3:
        out = take(hexes, r.choice([32, 40, 40, 48, 64]))
        return out.upper() if r.random() < 0.3 else out
    return [
        lambda: "AKIA" + take(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + take(plain, 36),
        lambda: "sk_live_" + take(plain, 24), lambda: "xoxb-" + take(string.digits, 12) + "-" + take(plain, 24),
        lambda: "AIza" + take(plain + "_-", 35), lambda: base64.b64encode(r.randbytes(r.choice([24, 30, 48]))).decode(),
        lambda: take(plain + "!@#%_-", r.randrange(10, 24)),
    ][kind - 3]()


def _plain(r: random.Random) -> str:
    hexes = "0123456789abcdef"
    take = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    return r.choice([
        lambda: take(hexes, r.choice([32, 40, 64])), lambda: "-".join(take(hexes, n) for n in (8, 4, 4, 4, 12)),
        lambda: r.choice(WORDS) + "".join(r.choice(WORDS).title() for _ in range(r.randrange(1, 4))) + str(r.randrange(100)),
        lambda: "_".join(r.choice(WORDS) for _ in range(r.randrange(2, 5))) + "_" + str(r.randrange(1000)), lambda: take(string.digits, r.choice([16, 18, 20])),
        lambda: "/".join(r.choice(WORDS) for _ in range(3)) + f"/{r.randrange(9999)}", lambda: r.choice("x0a") * r.randrange(16, 40) + "1a",
        lambda: "YOUR_API_KEY_HERE_1", lambda: "abcdef0123456789" * r.randrange(1, 3), lambda: f"2024-0{r.randrange(1, 9)}-1{r.randrange(9)}T0{r.randrange(9)}-00-00Z",
        lambda: "-".join(r.choice(WORDS) for _ in range(r.randrange(3, 6))) + str(r.randrange(10)), lambda: "example_token_" + take(string.digits, 4),
        lambda: take(string.digits, 3) + "-" + take(string.digits, 4) + "-" + take(string.ascii_lowercase, 9),
    ])()


def _closing(lead: str) -> str:
    return lead[-1] if lead.endswith(('"', "'")) else " "


def labelled(n: int = 4000, seed: int = 17) -> list[tuple[str, str, str, str, int]]:
    """n findings (candidate, text before, text after, path, is it a secret)."""
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        words = lambda: " ".join(r.choice(WORDS) for _ in range(r.randrange(0, 5)))
        if r.random() < 0.5:
            lead = r.choice(SECRET_LEADS)
            row = (_secret(r), f"{words()} {lead}", _closing(lead) + words(), r.choice(SECRET_PATHS + [""] * 6), 1)
        else:
            # Some plain strings stand behind an assignment too, and some secrets' shapes stand in plain places.
            candidate, lead = _plain(r), r.choice(PLAIN_LEADS)
            if r.random() < 0.15 and not set(candidate) <= set("0123456789abcdef"):
                lead = r.choice(SECRET_LEADS)
            row = (candidate, f"{words()} {lead}", _closing(lead) + words(), r.choice(PLAIN_PATHS + [""] * 6), 0)
        rows.append(row)
    return rows
