"""DataFrame operators: extraction, rules, compliance, review, audit, geometry, dashboards."""
