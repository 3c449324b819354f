"""DataFrame -> DataFrame operators.

clean        filters, week-key validity, clamps, null handling, parameter filter
joins        master joins, first/last lookups, key overlays, scalar-subquery globals
aggs         per-key aggregates, statistics on every row, pivots
windows      centred moving frames, ratios, ranks (incl. exact split rank), top-n
series       gap fill, horizon rows, moving ratio, active keys, recent weeks
seasonality  robust (clip + smooth) and simple indices, profiles, weekly index
cluster      rank-ratio item clusters
forecast     recent-mean and level x seasonality forecasts
promo        promotion price imputation, sales x promotion, promotion lookups
ml           decision-tree regression, k-means, metrics
text         line splitting / re-joining of page texts
"""
