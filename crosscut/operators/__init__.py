"""DataFrame to DataFrame operators over lines, findings and reports."""
