"""rankflow: Spark-native ranking of the options inside search sessions.

DataFrame-in / DataFrame-out operators plus fit -> model -> transform pairs for
the steps that learn state (encoders, imputers, price tiers, rankers).
"""

__version__ = "0.1.0"

SESSION_KEY = "ranker_id"
ROW_KEY = "Id"
LABEL = "selected"
