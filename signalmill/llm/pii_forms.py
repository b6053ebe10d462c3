"""Written forms of personal data and of what only looks like it, from which the trees learn kinds that have no base pattern.

Each line is (kind, form, whether it is personal data, text); in braces stands what is drawn anew for each example: the span itself between
the marks < and >. Lines alternate between learning and setting thresholds, so that thresholds are measured on wordings that were not learnt from.
"""

from __future__ import annotations

import random
import string

# Example wordings, ours.
LINES = (
    ("secret", "assigned", True, 'token = "<{hex40}>"'),
    ("secret", "assigned", True, "api_key: <{mixed32}>"),
    ("secret", "assigned", True, "export SECRET_KEY=<{mixed40}>"),
    ("secret", "assigned", True, "password = '<{password}>'"),
    ("secret", "assigned", True, "pwd: <{password}>"),
    ("secret", "assigned", True, 'the token is set by token="<{hex32}>" in the file'),
    ("secret", "assigned", True, "auth_token=<{mixed40}>"),
    ("secret", "assigned", True, 'access-key: "<{hex40}>"'),
    ("secret", "assigned", False, "password: <{word}>"),
    ("secret", "assigned", False, "token = <{word}_{word}>"),
    ("secret", "assigned", False, "the secret: <{word}>"),
    ("secret", "assigned", False, "Auth: <{word}, 2019>"),
    ("secret", "assigned", False, "password: <********>"),
    ("secret", "assigned", False, "token: <{word}.{word}()>"),
    ("secret", "long_run", True, "Authorization: Bearer <{mixed40}>"),
    ("secret", "long_run", True, "the key <AKIA{upper16}> was used"),
    ("secret", "long_run", True, "use <ghp_{mixed36}> to log in"),
    ("secret", "long_run", True, "sk_live key <sk-{mixed32}> is ours"),
    ("secret", "long_run", True, "secret token <{hex40}>"),
    ("secret", "long_run", True, "our credential <{mixed40}> here"),
    ("secret", "long_run", False, "commit <{hex40}>"),
    ("secret", "long_run", False, "sha256 of the file <{hex64}>"),
    ("secret", "long_run", False, "checksum <{hex32}> matches"),
    ("secret", "long_run", False, "md5 <{hex32}>"),
    ("secret", "long_run", False, "see /data/<{word}_{word}_{word}_20240101> for it"),
    ("secret", "long_run", False, "id <{hex8}-{hex4}-{hex4}-{hex4}-{hex12}> of the row"),
    ("secret", "long_run", False, "https://example.org/<{word}-{word}-{word}-{word}-12>"),
    ("secret", "long_run", False, "release <{word}-1-20-3-{word}-build-77> came"),
    ("iban", "iban", True, "pay to <{iban}> today"),
    ("iban", "iban", True, "IBAN: <{iban}>"),
    ("iban", "iban", True, "my account is <{iban}>."),
    ("iban", "iban", True, "Konto <{iban}> bei der Bank"),
    ("iban", "iban", False, "part <{notiban}> of the list"),
    ("iban", "iban", False, "order no. <{notiban}>"),
    ("iban", "iban", False, "model <{notiban}> is sold out"),
    ("iban", "iban", False, "code <{notiban}>"),
    ("national_id", "ssn", True, "SSN <{ssn}>"),
    ("national_id", "ssn", True, "his social security number is <{ssn}>"),
    ("national_id", "ssn", True, "ssn: <{ssn}> of the patient"),
    ("national_id", "ssn", True, "social security no. <{ssn}>"),
    ("national_id", "ssn", False, "part no. <{ssn}>"),
    ("national_id", "ssn", False, "catalogue <{ssn}> of parts"),
    ("national_id", "ssn", False, "the range <{ssn}> and others"),
    ("national_id", "ssn", False, "invoice <{ssn}>"),
    ("national_id", "checked_id", True, "DNI <{dni}>"),
    ("national_id", "checked_id", True, "con DNI número <{dni}>,"),
    ("national_id", "checked_id", True, "numéro de sécurité sociale <{nir}>"),
    ("national_id", "checked_id", True, "née le 3 mai, <{nir}>"),
    ("national_id", "checked_id", False, "artículo <{notdni}>"),
    ("national_id", "checked_id", False, "referencia <{notdni}> del pedido"),
    ("national_id", "checked_id", False, "ref. <{notnir}>"),
    ("national_id", "checked_id", False, "numéro de commande <{notnir}>"),
    ("address", "address", True, "lives at <{n3} {Name} Street>"),
    ("address", "address", True, "send it to <{n2} {Name} {Name} Road>, please"),
    ("address", "address", True, "wohnt in der <{Name}straße {n2}>"),
    ("address", "address", True, "Adresse: <{Name}weg {n2}>"),
    ("address", "address", True, "habite <rue de {Name}, {n2}>"),
    ("address", "address", True, "vive en <calle {Name} {n2}>"),
    ("address", "address", False, "in <1914 {Name} Road> was built"),
    ("address", "address", False, "page <{n2} {Name} Way> of the book"),
    ("address", "address", False, "the <{n2} {Name} Court> rulings"),
    ("address", "address", False, "Kapitel <{Name}weg {n2}> im Buch"),
    ("address", "address", False, "figure <{n2} {Name} Drive>"),
    ("address", "address", False, "version <{n2} {Name} Place>"),
)
_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def iban_ok(text: str) -> bool:
    """The check of international account numbers: moved round, letters as 10 to 35, the remainder by 97 is 1."""
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and s.isalnum() and s.isascii() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def id_ok(text: str) -> bool:
    """The checks of Spanish and of French identity numbers."""
    s = "".join(c for c in text if c.isalnum())
    if len(s) == 9 and s[:8].isdigit() and s[:8].isascii():
        return s[8] == _LETTERS[int(s[:8]) % 23]
    return len(s) == 15 and s.isdigit() and s.isascii() and 97 - int(s[:13]) % 97 == int(s[13:])


def _draw(name: str, rnd: random.Random) -> str:
    some = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    word = lambda n=None: some("aeiou", 1).join(some("bcdfglmnprst", 2) for _ in range(n or rnd.randrange(2, 4)))
    for kind, letters in (("hex", "0123456789abcdef"), ("mixed", string.ascii_letters + string.digits), ("upper", string.ascii_uppercase + string.digits)):
        if name.startswith(kind):
            return some(letters, int(name[len(kind) :]))
    if name in ("n2", "n3"):
        return str(rnd.randrange(1, 10 ** int(name[1])))
    if name == "word":
        return word()
    if name == "Name":
        return word().capitalize()
    if name == "password":
        return word() + some("!#$%&*", 1) + some(string.digits, rnd.randrange(2, 5)) + some(string.ascii_letters, rnd.randrange(0, 4))
    if name in ("iban", "notiban"):
        land = rnd.choice(("DE", "FR", "ES", "GB"))
        body = some(string.ascii_uppercase, 4) + some(string.digits, 14) if land == "GB" else some(string.digits, rnd.choice((18, 20, 22)))
        check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{land}00")) % 97  # two digits that make the remainder 1
        whole = f"{land}{check if name == 'iban' else (check + rnd.randrange(1, 90)) % 97:02d}{body}"
        return " ".join(whole[i : i + 4] for i in range(0, len(whole), 4)) if rnd.random() < 0.5 else whole
    if name == "ssn":
        return f"{some(string.digits, 3)}-{some(string.digits, 2)}-{some(string.digits, 4)}"
    if name in ("dni", "notdni"):
        n = rnd.randrange(10_000_000, 99_999_999)
        return f"{n}{rnd.choice(('', '-'))}{_LETTERS[(n + (name == 'notdni') * rnd.randrange(1, 22)) % 23]}"
    n = int(f"{rnd.choice('12')}{some(string.digits, 2)}{rnd.randrange(1, 13):02d}{some(string.digits, 8)}")
    return f"{n}{97 - (n + (name == 'notnir') * rnd.randrange(1, 90)) % 97:02d}"


def examples(each: int, seed: int = 5) -> list[tuple[str, int, int, str, str, bool, bool]]:
    """(text, start, end, kind, form, label, whether it sets thresholds): so many of each line, with other words around."""
    rnd, out = random.Random(seed), []
    for place, (kind, form, label, line) in enumerate(LINES):
        for _ in range(each):
            text, at = [], 0
            while (begin := line.find("{", at)) >= 0:
                end = line.index("}", begin)
                text += [line[at:begin], _draw(line[begin + 1 : end], rnd)]
                at = end + 1
            words = [" ".join(_draw("word", rnd) for _ in range(rnd.randrange(0, 5))) for _ in range(2)]
            whole = f"{words[0]} {''.join([*text, line[at:]])} {words[1]}"
            start = whole.index("<")
            span = whole[start + 1 : whole.index(">")]
            out.append((whole.replace("<", "", 1).replace(">", "", 1), start, start + len(span), kind, form, label, place % 2 == 1))
    return out
