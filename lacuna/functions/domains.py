"""Public suffixes: the part of a host below which names are registered, by the longest rule over its labels.

Rules are suffixes, ``*.suffix`` (any one label below it) and ``!name`` (an exception to such a rule). The built-in list
holds common ones; ``read_rules`` takes a whole list from a file. Rules are looked up as hashed sets of literals, so a list of
more than ``RULES`` is refused.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lacuna.functions.spans import by_sql, let

RULES = 20_000
# Common public suffixes; the words among them, which without a scheme are no web addresses by themselves.
SUFFIXES = """
com org net edu gov mil int info biz name pro aero coop museum mobi jobs tel cat xxx international io ai app dev cloud online site store tech xyz health care clinic hospital doctor dental
at be ca cc ch cl cn co cz de dk ee es eu fi fr gr hk hr hu ie il in is it jp kr li lt lu lv ly mc mx my nl no nu nz pe ph pk pl pt ro rs ru se sg si sk th tk tr tv tw ua uk us uy ve vn ws za au br ar id
co.nz ac.nz geek.nz gen.nz govt.nz health.nz iwi.nz kiwi.nz maori.nz mil.nz net.nz org.nz parliament.nz school.nz cri.nz
com.au net.au org.au edu.au gov.au asn.au id.au
co.uk ac.uk gov.uk ltd.uk me.uk net.uk nhs.uk org.uk plc.uk police.uk sch.uk
com.br gov.br net.br org.br com.cn edu.cn gov.cn net.cn org.cn co.il org.il ac.il co.in net.in org.in gov.in ac.in co.jp ac.jp go.jp ne.jp or.jp co.kr or.kr go.kr com.mx org.mx gob.mx com.my org.my gov.my com.sg org.sg edu.sg gov.sg com.tr org.tr gov.tr com.tw org.tw com.ar org.ar gob.ar co.za org.za gov.za ac.za co.id or.id go.id com.hk org.hk com.ph org.ph com.pk org.pk com.vn com.ua
*.ck !www.ck *.bd *.fk *.np *.kawasaki.jp !city.kawasaki.jp
""".split()
WORDS = "name pro cat jobs tel app cloud online site store tech care clinic hospital doctor dental international at be in is it my no id us".split()


def read_rules(path: str) -> tuple[str, ...]:
    """Rules of a file with one on a line; what follows white space, and lines that begin with //, say nothing."""
    with open(path, encoding="utf-8") as f:
        lines = [line.split()[0].lower() for line in f if line.strip() and not line.startswith("//")]
    return tuple(lines)


class Suffixes:
    def __init__(self, rules: Iterable[str] = SUFFIXES):
        rules = {*rules}
        if odd := [r for r in rules if not r or set(r) & set("'\\\n")]:
            raise ValueError(f"no rules of suffixes: {odd[:3]}")
        if len(rules) > RULES:
            raise ValueError(f"more than {RULES} rules of suffixes")
        self.exceptions = sorted(r[1:] for r in rules if r[0] == "!")
        self.wild = sorted(r[2:] for r in rules if r.startswith("*."))
        self.plain = sorted(r for r in rules if r[0] not in "!*")
        self.labels = max([1, *(r.count(".") + 1 for r in self.plain), *(r.count(".") + 2 for r in self.wild), *(r.count(".") + 1 for r in self.exceptions)])

    def last_labels(self) -> list[str]:
        """What hosts under the rules may end with."""
        return sorted({r.rpartition(".")[2] for r in (*self.plain, *self.wild, *self.exceptions)})

    def _size_sql(self) -> str:
        """Labels of the public suffix of a host ``h`` in lower case: an exception's without its first label, else the longest rule's."""
        among = lambda end, rules: f"{end} IN ({', '.join(repr(r) for r in rules)})" if rules else "false"
        own = lambda n: f"substring_index(h, '.', -{n})"
        has = lambda n: f"size(split(h, '[.]')) >= {n}"
        ways = [f"WHEN {has(n)} AND {among(own(n), self.exceptions)} THEN {n - 1}" for n in range(self.labels, 1, -1)]
        ways += [f"WHEN {has(n)} AND ({among(own(n), self.plain)}{f' OR {among(own(n - 1), self.wild)}' if n > 1 else ''}) THEN {n}" for n in range(self.labels, 0, -1)]
        return f"CASE {' '.join(ways)} ELSE 0 END"

    def size(self, host: Column) -> Column:
        """Labels of a host's public suffix; 0 if no rule fits it."""
        return by_sql(F.lower(host), "h", self._size_sql())

    def registered(self, host: Column) -> Column:
        """Whether a host lies below a public suffix, and is none itself."""
        return let(self.size(host), lambda size: (size > 0) & (F.size(F.split(host, r"\.")) > size))

    def web_address(self, host: Column) -> Column:
        """Whether a host without a scheme is taken for a web address: registered, and not just a word behind a full stop."""
        word = by_sql(F.lower(F.substring_index(host, ".", -1)), "w", f"w IN ({', '.join(map(repr, WORDS))})")
        labels = F.size(F.split(host, r"\."))
        return let(self.size(host), lambda size: (size > 0) & (labels > size) & ((size > 1) | ~word))



KNOWN = Suffixes()
