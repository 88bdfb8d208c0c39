"""Tables of rules: fees by tier, terms, routes. Each is one expression, so it stays in the scan's stage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import cents

#: Fixed values: (upper limit, fixed part, share of what exceeds the floor, floor).
ARBITRATION = ((100_000, 10_000, 0.0, 0), (1_000_000, 10_000, 0.05, 100_000), (10_000_000, 55_000, 0.03, 1_000_000), (50_000_000, 325_000, 0.01, 10_000_000), (None, 725_000, 0.005, 50_000_000))
ARBITRATION_CAP = 10_000_000
GENERAL = ((100_000, 4_000, 0.0, 0), (300_000, 4_000, 0.03, 100_000), (500_000, 10_000, 0.025, 300_000), (1_000_000, 15_000, 0.02, 500_000), (3_000_000, 25_000, 0.01, 1_000_000), (8_000_000, 45_000, 0.007, 3_000_000), (24_000_000, 80_000, 0.0035, 8_000_000), (50_000_000, 136_000, 0.003, 24_000_000), (100_000_000, 214_000, 0.002, 50_000_000), (None, 314_000, 0.0015, 100_000_000))
GENERAL_CAP = 900_000
REFUND = {"first": 0.7, "appeal": 0.5, "cassation": 0.3}
RELIEF_LIMIT = 1_000_000


def tiered(price: Column, tiers, cap: float) -> Column:
    """Fee of a price; null for null or negative prices."""
    out, last = None, None
    for top, fixed, share, floor in tiers:
        value = F.lit(float(fixed)) + F.lit(share) * (price - F.lit(float(floor)))
        if top is None:
            last = value
        else:
            out = F.when(price <= top, value) if out is None else out.when(price <= top, value)
    return F.when(price >= 0, cents(F.least(out.otherwise(last), F.lit(float(cap)))))


def arbitration_fee(price: Column) -> Column:
    return tiered(price, ARBITRATION, ARBITRATION_CAP)


def general_fee(price: Column) -> Column:
    return tiered(price, GENERAL, GENERAL_CAP)


def order_fee(price: Column) -> Column:
    """Half the fee, 8 000 at least."""
    return F.greatest(cents(arbitration_fee(price) * 0.5), F.lit(8000.0))


def relieved_fee(price: Column) -> Column:
    """Exempt up to a limit; above it what exceeds the limit's own fee."""
    return cents(F.greatest(F.lit(0.0), general_fee(price) - general_fee(F.lit(float(RELIEF_LIMIT)))))


def refund(fee: Column, stage: Column, admitted: Column) -> Column:
    share = F.lit(0.0)
    for k, v in REFUND.items():
        share = F.when(stage == k, v).otherwise(share)
    return cents(F.when(admitted, F.lit(0.0)).otherwise(fee * share))


def proceeding(amount: Column, court: Column, debtor: Column, mandatory: Column) -> Column:
    """order, simplified or general, by amount, court and kind of debtor."""
    limit = F.when(mandatory, 100_000).when(court == "arbitration", 750_000).otherwise(500_000)
    simple = F.when(court == "general", 250_000).when(debtor == "entity", 1_200_000).otherwise(600_000)
    return F.when(amount <= limit, "order").when(amount <= simple, "simplified").otherwise("general")


def appeal_deadline(decided: Column, kind: Column) -> Column:
    return F.when(kind == "ruling", F.date_add(decided, 15)).otherwise(F.add_months(decided, 1))


def cassation_deadline(in_force: Column, target: Column) -> Column:
    return F.when(target == "ruling", F.add_months(in_force, 1)).otherwise(F.add_months(in_force, 2))


def register_close(published: Column, procedure: Column) -> Column:
    """Null without a publication date, which is a valid outcome."""
    return F.when(procedure == "observation", F.date_add(published, 30)).otherwise(F.add_months(published, 2))


def writ_deadline(in_force: Column, deferred_to: Column) -> Column:
    return F.add_months(F.coalesce(deferred_to, in_force), 36)


def urgency(deadline: Column, today: Column) -> Column:
    left = F.datediff(deadline, today)
    return F.when(left < 0, "missed").when(left < 5, "critical").when(left < 15, "soon").otherwise("calm")


def schedule_breach(due: Column, paid: Column, today: Column) -> Column:
    return (due < today) & ~F.coalesce(paid, F.lit(False))


def major_deal(total: Column, assets: Column) -> Column:
    return F.coalesce(F.try_divide(total, assets) >= 0.25, F.lit(False))


def cost_share(fee: Column, granted: Column, claimed: Column) -> Column:
    return cents(fee * F.try_divide(granted, claimed))


def fee_awarded(paid: Column, due: Column, granted: Column, claimed: Column, separate: Column) -> dict[str, Column]:
    """What a judgment says of the fee: due is halved in separate disputes; the granted share of it is awarded, the rest stays
    with the claimant, and what was paid above it goes back from the budget. Null where nothing was claimed."""
    own = F.when(separate, cents(due * 0.5)).otherwise(cents(due))
    part = F.try_divide(granted, claimed)
    share = F.when(part > 1, F.lit(1.0)).otherwise(part)
    awarded = cents(own * share)
    return {"due": own, "awarded": awarded, "borne": cents(own - awarded), "refund": cents(F.greatest(paid - own, F.lit(0.0)))}


def delivered(returned: Column, proper_address: Column) -> Column:
    """Return by expiry counts only for a properly grounded address: true, false or unknown (null)."""
    return F.when(~returned, F.lit(True)).when(proper_address.isNull(), F.lit(None).cast("boolean")).otherwise(proper_address)


def by_priority(document: Column, tracker: Column) -> dict[str, Column]:
    """The document's value before the tracker's, with a flag where they differ."""
    return {"value": F.coalesce(document, tracker), "conflict": F.coalesce(document != tracker, F.lit(False))}


#: Flat fees of the arbitration courts by kind of paper, for persons and for companies.
FLAT = {
    "contract": (15_000, 50_000), "unvalued": (15_000, 50_000), "non-normative": (10_000, 50_000), "creditor-bankruptcy": (10_000, 100_000),
    "own-bankruptcy": (0, 0), "legal-fact": (30_000, 30_000), "succession": (5_000, 25_000), "writ-paper": (10_000, 10_000), "new-facts": (30_000, 30_000),
    "interim-measure": (30_000, 30_000), "delay": (300, 6_000), "appeal": (10_000, 30_000), "cassation": (20_000, 50_000), "supreme": (30_000, 80_000),
}
#: Shares of the tiered fee.
SHARES = {"separate-dispute": 0.5, "arbitral-writ": 0.3}
#: Requests without a fee.
FREE = ("indexation", "clerical-error", "astreinte", "lift-interim", "secure-evidence", "copies", "restore-term", "bailiff-fee")
#: Limitation in months by category, and the utmost term from the breach.
LIMITATION = {"general": 36, "voidable": 12, "void": 36, "carriage": 12, "works": 12, "buildings": 36, "property-insurance": 24, "pre-emption": 3, "labour": 3, "wages": 12}
UTMOST = 120
#: Stage of a case by its status.
STAGES = {
    "active": "1 инстанция", "suspended": "1 инстанция (приостановлено)", "pending_appeal": "Апелляция", "pending_cassation": "Кассация", "pending_settlement": "Примирение",
    "settled": "Завершено (мировое)", "withdrawn": "Завершено (отказ)", "enforcement": "Исполнение", "completed": "Решение вступило в силу", "archived": "Закрыто",
}
#: The shard of a category, and the court that a category is routed to.
SHARDS = {
    "исковое (АПК)": "исковое-АПК", "экономические споры": "исковое-АПК", "банкротство": "банкротство", "корпоративный спор": "корпоративный-спор",
    "административное (АПК)": "административное-АПК", "исковое (ГПК)": "исковое-ГПК", "трудовой спор": "трудовой-спор", "административное (КАС)": "административное-КАС",
}
ROUTES = {
    "исковое (АПК)": "арбитражный", "экономические споры": "арбитражный", "банкротство": "банкротный", "корпоративный спор": "арбитражный",
    "административное (АПК)": "арбитражный", "исковое (ГПК)": "СОЮ", "трудовой спор": "СОЮ", "административное (КАС)": "КАС",
}
#: Terms of complaints by court and instance, in months; and short terms in days.
TERMS = {("general", "appeal"): 1, ("general", "cassation"): 3, ("general", "supreme"): 3, ("general", "supervision"): 3, ("insolvency", "appeal"): 1, ("insolvency", "cassation"): 2, ("insolvency", "supreme"): 2}
SHORT_TERMS = {"bailiff": 10, "removal": 10, "public-event": 10, "dissolution": 10}


def lookup(key: Column, table: dict) -> Column:
    """The table's value for a key; null for any other key and for null."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def flat_fee(kind: Column, company: Column) -> Column:
    """The flat fee of a kind of paper; null for a kind that has none."""
    return F.when(company, lookup(kind, {k: v[1] for k, v in FLAT.items()})).otherwise(lookup(kind, {k: v[0] for k, v in FLAT.items()})).cast("double")


def shared_fee(kind: Column, price: Column) -> Column:
    """A share of the tiered fee, for kinds that are charged so; an order is half of it, 8 000 at least."""
    return F.when(kind == "order", order_fee(price)).otherwise(cents(arbitration_fee(price) * lookup(kind, SHARES)))


def request_fee(kind: Column, fee: Column) -> Column:
    """Each request bears its own fee; those of the list bear none."""
    return F.when(kind.isin(*FREE), F.lit(0.0)).otherwise(fee)


def claim_ready(start_from: Column, sent: Column, received: Column, registered: Column, wait_days: Column) -> Column:
    """From when a claim may be filed: the waiting term (30 days where none is named) from the point the rule names;
    null while that date is not known."""
    start = F.when(start_from == "receipt", received).when(start_from == "registration", registered).otherwise(sent)
    return F.date_add(start, F.coalesce(wait_days, F.lit(30)).cast("int"))


def limitation_end(category: Column, known: Column, breached: Column) -> Column:
    """The end of the limitation, ten years after the breach at the latest; unknown categories: the general term."""
    months = F.coalesce(lookup(category, LIMITATION), F.lit(LIMITATION["general"]))
    return F.least(F.add_months(known, months), F.add_months(breached, UTMOST))


def stage(status: Column) -> Column:
    return lookup(status, STAGES)


def outcome(source: Column, value: Column) -> Column:
    """granted, partial, denied or null, by what the card says of the paper; anything else is null, never a guess."""
    complaint = F.when(value.isin("overturned", "modified"), "granted").when(value.isin("upheld", "dismissed"), "denied")
    adjusted = F.when(value.isin("granted", "partial", "denied"), value)
    return F.when(source.isin("appeal", "cassation"), complaint).when(source == "adjustment", adjusted).when((source == "status") & value.isin("settled", "withdrawn"), "granted")


def shard(category: Column) -> Column:
    """The file of a category by the closed table; a category outside it has none."""
    return lookup(category, SHARDS)


def route(category: Column) -> Column:
    return lookup(category, ROUTES)


def complaint_deadline(court: Column, instance: Column, decided: Column) -> Column:
    """By court and instance, in months; null where the table has no such term."""
    return F.add_months(decided, lookup(F.concat_ws("/", court, instance), {"/".join(k): v for k, v in TERMS.items()}))


def short_deadline(kind: Column, known: Column) -> Column:
    return F.date_add(known, lookup(kind, SHORT_TERMS))


def file_name_key(name: Column) -> Column:
    """File names compare by this, not by bytes: lower case, ё as е, runs of blanks and underscores as one blank."""
    return F.trim(F.regexp_replace(F.translate(F.lower(name), "ё", "е"), r"[\s_]+", " "))
