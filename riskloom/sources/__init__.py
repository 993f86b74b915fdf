"""Where rows come from: code files, findings, advisories."""
