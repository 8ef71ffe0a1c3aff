"""DataFrame operators: table transforms, staging models, marts, reports and data checks."""
