"""DataFrame operators: headers, scope, search, rules, output, mapping, reports."""
