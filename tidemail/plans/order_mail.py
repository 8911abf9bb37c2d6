"""Example generation plan: delivery notices, one for each order.

The columns depend on the order's own values: urgent orders are held or
delayed more often, and a carrier's depots follow from the carrier.  Depots of
one word have no desk address, so their notices fail and are rejected.
"""

from __future__ import annotations

from tidemail.plans.generate import Category, Expr, Person, Plan, Subcategory, Text, Uniform

CARRIERS = {
    "Northline": ["Northline Hub East", "Northline Hub West", "Airfield"],
    "Harbor Post": ["Harbor Quay Seven", "Harbor Quay Nine", "Harbor Gate"],
    "Swift Mule": ["Swift Yard", "Swift Yard Annex"],
}
CARRIER_SHARES = [5, 3, 2]
NOTICES = ["shipped", "delayed", "held at customs"]
NOTICE_SHARES = [7, 2, 1]
NOTICE_SHARES_URGENT = [4, 3, 3]
LANGUAGES = ["en", "nl", "pt", "sv"]

TITLE_PROMPT = "Give a short title for a notice that order {{o_orderkey}} is {{notice}}."
TITLE = "Order {{o_orderkey}}: {{ notice | upper }}"
NOTICE_PROMPT = ("Tell {{receiver}}, in language {{language}}, that {{parcels}} parcel(s) of order {{o_orderkey}} are {{notice}} "
                 "at {{depot}}. {% if receiver_age < 40 %}Offer the app.{% else %}Offer a call.{% endif %}")
NOTICE = ("Hello {{receiver}}, {{parcels}} parcel(s) by {{carrier}} are {{notice}}. "
          "{% if receiver_age < 40 %}Track them in the app{% else %}Call {{depot}}{% endif %} or write to "
          "{{ depot.split()[1] | lower }}.{{ depot.split()[-1] | lower }}@{{host}}.")


def order_mail_plan(host: str = "example.edu", priority_col: str = "o_orderpriority", generator=None) -> Plan:
    p = Plan()
    p.add("contact", Person(age_range=(21, 70)), drop=True)
    p.add("receiver", Expr("{{ contact.first_name }} {{ contact.last_name }}"))
    p.add("receiver_age", Expr("{{ contact.age }}", dtype="int"))
    p.add("carrier", Category(list(CARRIERS), CARRIER_SHARES))
    p.add("depot", Subcategory("carrier", CARRIERS))
    p.add("notice", Category(NOTICES, NOTICE_SHARES, when={f"{priority_col} = '1-URGENT'": Category(NOTICES, NOTICE_SHARES_URGENT)}))
    p.add("language", Category(LANGUAGES))
    p.add("parcels", Uniform(1, 6, convert_to="int"))
    p.add("host", Expr(host), drop=True)
    p.add("title", Text(TITLE_PROMPT, response=TITLE))
    p.add("message", Text(NOTICE_PROMPT, response=None if generator else NOTICE, generator=generator))
    return p
