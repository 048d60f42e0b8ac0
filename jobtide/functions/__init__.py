"""Column functions: text canonicalizers, links, dates. All are JVM expressions."""
